import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustline.llm import fim

TEXTS = [
    None, "", " ", "a", "word", "two words", "<P>", "a <S> b", "x<M", "<", "x<S", "P>x", "é🎉 mixed 中文 text", "a\nb\r\n\tc", "\x00nul\x7f",
    "word, é🎉 " * 3000, "a" * 20_000, "é" * 15_000 + "<P", ". " * 9000, "x" * 999 + " " + "y" * 1001,
]


def brute(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    marked = any(x in text for x in ("<P>", "<S>", "<M>"))
    form = "plain" if not text or marked or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (i, len(units), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, fim.fim_report(df).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)


def test_against_brute_force(spark):
    check(spark, [(i * len(TEXTS) + k, text) for i in range(4) for k, text in enumerate(TEXTS)] + [(None, "no id"), (None, "no id")])


@pytest.mark.parametrize("segment", [1, 10, 1000])
def test_texts_in_segments(monkeypatch, segment):
    monkeypatch.setattr(fim, "SEGMENT_BYTES", segment)
    rng = random.Random(segment)
    for text in TEXTS:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
        first, second = rng.randrange(1 << 32), rng.randrange(1 << 32)
        a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
        n, parts = fim._pieces(pa.array([(text or "").encode()], pa.large_binary()), np.array([first]), np.array([second]))
        assert n.tolist() == [len(units)]
        assert [p[0].as_py().decode() for p in parts] == ["".join(u) for u in (units[:a], units[a:b], units[b:])]


def test_long_text_is_not_cut(spark):
    check(spark, [(1, "word, é🎉 " * 400_000), (2, "a" * 3_000_000), (4, "é" * 1_500_000)])


@pytest.mark.parametrize("segment", [1, 2, 7, 64])
def test_segments_part_no_unit(monkeypatch, segment):
    monkeypatch.setattr(fim, "SEGMENT_BYTES", segment)
    rng = random.Random(segment)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Zz", " ", "é", "🎉", "中", "\n"]) for _ in range(rng.randint(0, 60)))
        parts = fim._segments(text.encode())
        assert b"".join(parts) == text.encode()
        split = [u for part in parts for u in re.findall("[A-Za-z]+|[^A-Za-z]", part.decode())]
        assert split == re.findall("[A-Za-z]+|[^A-Za-z]", text)


def test_output_texts_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"some text {i}, with parts") for i in range(300)], "doc_id long, text string")
    made = fim.fill_in_middle(df.withColumn("n", F.lit("own")).withColumn("_row", F.lit(1)))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = fim.restore(made.withColumn("restored", F.lit("old")).withColumn("_form", F.lit(2)))
    assert back.join(df, "doc_id").where("restored <> text or _form <> 2").isEmpty() and back.count() == 300
    assert fim.fim_report(df.limit(0)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert fim.restore(fim.fill_in_middle(broken)).first().restored == "a�b"
