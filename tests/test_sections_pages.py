import os
import time

import pytest
from pyspark.sql import functions as F

from gustline.operators import sections
from gustline.sinks import tables
from gustline.sources import pages

FORECAST = "intro\nANZ530-bay\nwinds.\nANZ535-river\nSW wind 5 kt.\nwaves 1 ft\nANZ536-other\nx"


def test_forecast_section(values):
    cut = lambda s: lambda c: sections.forecast_section(c, s)
    assert values(cut("ANZ535"), FORECAST) == ["ANZ535-river\nSW wind 5 kt.\n\nwaves 1 ft\n"]
    assert values(cut("ANZ530"), FORECAST) == ["ANZ530-bay\nwinds.\n\n"]
    assert values(cut("ANZ536"), FORECAST) == ["ANZ536-other\nx"]
    assert values(cut("ANZ999"), FORECAST, None) == ["", None]


def test_section_lines_and_text(spark):
    rows = [("d", i, line) for i, line in enumerate(FORECAST.split("\n"))]
    lines = spark.createDataFrame(rows, "doc string, pos int, line string")
    header = F.when(F.col("line").rlike(r"^ANZ\d{3}"), F.substring("line", 1, 6))
    found = sections.section_lines(lines, "doc", "pos", header)
    got = [(r.pos, r.section_pos, r.section) for r in found.orderBy("pos").collect()]
    assert got == [(1, 1, "ANZ530"), (2, 1, "ANZ530"), (3, 3, "ANZ535"), (4, 3, "ANZ535"), (5, 3, "ANZ535"), (6, 6, "ANZ536"), (7, 6, "ANZ536")]


def test_written_sections_keep_their_order(spark, tmp_path):
    rows = [("d", i, "H" if i % 50 == 0 else f"line {i}, \"quoted\"\nand broken") for i in range(500)]
    lines = spark.createDataFrame(rows, "doc string, pos int, line string").repartition(5)
    found = sections.section_lines(lines, "doc", "pos", F.when(F.col("line") == "H", F.col("line")))
    tables.write_sections(found, str(tmp_path / "s"), "doc", "pos", "line")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = sorted(n for n in os.listdir(tmp_path / "s") if n.startswith("part"))
    back = [(int(r.pos), r.line) for n in names for r in reader.csv(str(tmp_path / "s" / n)).collect()]
    assert back == [(i, line) for _, i, line in rows]


def test_cell_sections(spark):
    df = spark.createDataFrame([(1, FORECAST), (2, None), (3, "no header"), (4, "ANZ1\n\nANZ2")], "i int, t string")
    rows = sections.cell_sections(df, "t", ["i"], r"ANZ\d").orderBy("i", "section_no").collect()
    assert [(r.i, r.section_no, r.n_lines) for r in rows] == [(1, 0, 2), (1, 1, 3), (1, 2, 2), (4, 0, 2), (4, 1, 1)]
    assert rows[0].section_text == "ANZ530-bay\nwinds." and rows[3].section_text == "ANZ1\n"


def test_paragraphs(values):
    html = '<p class="warn-highlight">Gale warning</p><p>ANZ535-river\nwind.</p>'
    assert values(sections.paragraph_text, html) == ["Gale warning\n\n\nANZ535-river\nwind."]


def test_bulletin(values):
    html = "<div>top ANZ530-111111 a <b>x</b> ANZ535-222222 tidal<br/>potomac <!-- Start Tail --> foot</div>"
    assert values(lambda c: sections.bulletin_section(c, "ANZ535"), html) == ["ANZ535-222222 tidalpotomac"]
    assert values(lambda c: sections.bulletin_section(c, "ANZ999"), html) == ["<not found>"]


def test_history_table(spark):
    cells = "".join(f"<td>{c}</td>" for c in ["29", "08:52", "NW 8 G 25", "10.00", "Fair", "CLR", "28", "8", "", "", "43%", "20", "NA", "30.32", "1026.8", "", "", ""])
    html = f"<!-- <tr><td>no</td></tr> --><table><thead><tr><th>D<br>a</th></tr></thead><tr>{cells}</tr><tr><td>foot</td></tr></table>"
    page = spark.createDataFrame([("KDCA", html)], "station_id string, html string")
    rows = pages.history_rows(page, "html", ["station_id"], F.lit("2021-01-30").cast("date")).collect()
    assert len(rows) == 1
    rejects = pages.history_rejects(page, "html", ["station_id"], F.lit("2021-01-30").cast("date")).collect()
    assert [r["cells"] for r in rejects] == [["foot"]]
    earlier = pages.history_rows(page, "html", ["station_id"], F.lit("2021-01-02").cast("date")).first()
    assert (earlier["Year"], earlier["Month"]) == ("2020", "12")
    row = rows[0]
    assert (row["Date"], row["Wind (mph)"], row["Max."], row["Wind Chill (°F)"], row["Year"], row["Month"]) == ("29", "NW 8 G 25", None, "20", "2021", "1")


def test_links_ignore_scripts_and_comments(spark):
    html = '<script>"<a href=\\"/s\\">"</script><!-- <a href="/c"> --><a href="/1"></a><a class="x" href="/2"></a><a href="/3"></a>'
    page = spark.createDataFrame([(1, html), (2, '<a href="/only">')], "page_id int, html string")
    rows = pages.page_links(page, "html", ["page_id"]).orderBy("link_no").collect()
    assert [(r.page_id, r.link_no, r.href) for r in rows] == [(1, 0, "/1"), (1, 1, "/2"), (1, 2, "/3")]


def test_station_directory(spark):
    html = (
        "<table><tr><th>Station</th></tr>"
        '<tr><td><a href="p">Washington</a></td><td><a href="KDCA.rss">RSS</a></td><td><a href="KDCA.xml">XML</a></td></tr>'
        '<tr><td><a href="p">Short</a></td><td><a href="q">x</a></td></tr></table>'
    )
    page = spark.createDataFrame([("va", html)], "state string, html string")
    rows = pages.station_directory(page, "html", "state").collect()
    assert [(r.state, r.name, r.xml) for r in rows] == [("VA", "Washington", "KDCA.xml")]


LONG = {
    "<a without end": "<a " * 330_000, "<a and characters": "<a " + "x" * 1_000_000, "quotes": '<a "' * 250_000, "comments": "<!-- " * 200_000,
    "scripts": "<script>" * 125_000, "rows": "<tr>" * 250_000, "cells": "<tr>" + "<td>" * 250_000, "row tags": "<tr " * 250_000, "brackets": "<" * 1_000_000,
    "paragraphs": "<p>" * 330_000, "lines": "\n" * 1_000_000,
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_of_broken_markup(spark, name):
    df = spark.createDataFrame([(1, "<p>ok</p>" + LONG[name])], "page_id long, html string").withColumn("state", F.lit("va"))
    start = time.perf_counter()
    pages.page_links(df, "html", ["page_id"], 1).count()
    pages.table_rows(df, "html", ["page_id"]).select(F.sum(F.size("cells"))).collect()
    pages.station_directory(df, "html", "state").select(F.count("links")).collect()
    df.select(F.length(sections.paragraph_text("html"))).collect()
    assert time.perf_counter() - start < 20


def test_unclosed_rows_cells_and_comments(spark):
    html = "<table><tr><td>a<td><b>b</b></td><tr class='x'><td>c</table><!-- <tr><td>no"
    got = pages.table_rows(spark.createDataFrame([(1, html)], "i int, h string"), "h", ["i"]).orderBy("row_no").collect()
    assert [r.cells for r in got] == [["a", "b"], ["c"]]
