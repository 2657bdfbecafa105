import json
import random
import time

import pytest

from gustline.llm import wrapper
from gustline.llm.dom import parse

WORDS = "amber basin cedar delta ember fjord grove heron inlet juniper kelp lagoon maple nettle orchid pebble quartz river".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def site_page(rng, i, article=False):
    """A page of an invented site, and the text of its article."""
    paragraphs = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
    title = prose(rng, 5)
    body = "".join(f"<p>{p.replace(' ', ' <em>', 1).replace('.', '</em>.')}</p>\n" for p in paragraphs)
    inner = f"<h1>{title}</h1><div class='text'>{body}<p>Read our house rules before you write to us.</p></div>"
    inner = f"<article>{inner}</article>" if article else f"<div id=c{i % 3}>{inner}</div>"
    html = f"""<!doctype html><html><head><title>{title}</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
      <div class="site-header"><a href="/">Station</a> <span>{prose(rng, 3)}</span></div>
      <ul>{"".join(f"<li><a href='/{w}'>{w} {rng.randint(1, 99)}</a></li>" for w in rng.sample(WORDS, 6))}</ul>
      <div class="wrap">{inner}
      <div class="side-bar">{prose(rng, 12)}</div><section id="comments"><p>{prose(rng, 30)}</p></section></div>
      <form><p>{prose(rng, 4)}</p></form><div class="cookie-notice">{prose(rng, 9)}</div><footer>&copy; {prose(rng, 6)}</footer></body></html>"""
    return html, " ".join([title, *paragraphs])


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in wrapper.extraction_report(df).collect()}


@pytest.mark.parametrize("article", [True, False])
def test_site_with_constant_and_marked_parts(spark, article):
    rng = random.Random(5)
    made = [site_page(rng, i, article) for i in range(60)]
    rows = [(i, f"https://User@News.Example.org:8080/{i}", html) for i, (html, _) in enumerate(made)]
    got = extracted(spark, rows)
    assert {i: got[i].text for i in got} == {i: text for i, (_, text) in enumerate(made)}
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id][1] for r in got.values())


def test_copies_of_an_article_are_no_template(spark):
    rng = random.Random(6)
    html, text = site_page(rng, 0, article=True)
    texts = [prose(rng, 40) for _ in range(20)]
    near = "<article><h1>Title</h1>" + "".join(f"<p>{prose(rng, 30)}</p>" for _ in range(5)) + "<p>%s</p></article>"
    rows = [(i, "http://copies.example.org/", html) for i in range(20)]
    rows += [(100 + i, "http://near.example.org/", near % texts[i]) for i in range(20)]
    got = extracted(spark, rows)
    rules = " Read our house rules before you write to us."
    assert {got[i].text for i in range(20)} == {text + rules}
    for i in range(20):
        assert got[100 + i].text.startswith("Title ") and got[100 + i].text.endswith(texts[i])
        assert len(got[100 + i].text) > 5 * 80


ODD = [
    (None, ""), ("", ""), ("   ", ""), ("plain text &amp; more", "plain text & more"), ("<p>one<p>two", "one two"),
    ("a<b>b</b>c<br>d&nbsp;\n e", "abc d e"), ("<script>only script", ""), ("<!-- <p>only comment</p>", ""),
    ("<article><h1>H</h1><p>one<aside>no</aside>two</article><ul class='comment-list'><li>c</ul>", "H one two"),
    ("<form id=f><main><p>In form</p><form><input>no</form></main></form>", "In form"),
    ("<article class=post><div class=article-header><h1>H</h1></div>t<nav>x</nav><div class=share-links>s</div></article>", "H t"),
    ("<p hidden>no</p><p>yes</p><p style='display: none'>no</p>", "yes"), ("5 < 6 and 7 > 6 <3", "5 < 6 and 7 > 6 <3"),
    ("<div><h1>T</h1><b>x<p>para</p> tail</b> y</div>", "T x para tail y"), ('<a title="a > b">link</a> text', "link text"),
    ("&#99999999999; &#x41;", "� A"), ("<p>see <a>one</a>, <a>two</a></p>", "see one, two"), ("<p>\x00é🎉</p>", "\x00é🎉"),
]


def test_odd_pages(spark):
    rows = [(i, f"http://h{i}.example.org/x", html) for i, (html, _) in enumerate(ODD)]
    rows += [(900, None, "<p>no address</p>"), (901, "not an address", "<p>none</p>"), (None, "http://x.example.org", "<p>no id</p>")]
    got = extracted(spark, rows)
    assert {i: got[i].text for i in range(len(ODD))} == {i: text for i, (_, text) in enumerate(ODD)}
    assert (got[900].text, got[901].text, got[None].text) == ("no address", "none", "no id")
    assert extracted(spark, []) == {}


def test_other_columns_repeated_rows_and_small_steps(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i // 2, "https://a.example.org/", site_page(random.Random(i // 2), i // 2)[0], "x", 3) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string, host int")
    out = wrapper.main_text(df, text_column="host")
    assert out.columns == ["page_id", "url", "html", "_html", "host"] and out.count() == 40
    assert out.groupBy("page_id").agg({"host": "count"}).where("`count(host)` <> 2").isEmpty()
    held = wrapper._Held()
    monkeypatch.setattr(wrapper, "TEMPLATES_HELD", 1)
    for i in range(6):
        held.add(f"h{i % 2}", parse(site_page(rng, i)[0]), 1)
    rows = [row for batch in held.rows(last=True) for row in batch.to_pylist()]
    assert sum(r["pages"] for r in rows) == 6 and len(rows) == 6


def brute_match(a, b):
    """Simple tree matching as published: no trimming, no anchors."""
    if a.label != b.label:
        return 0
    if a.tag == "#":
        return 2 if a.hash == b.hash else 1
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return best[-1][-1] + 1


def test_matching_against_the_plain_recursion(monkeypatch):
    rng = random.Random(8)
    for i in range(40):
        a, b = (parse(site_page(rng, i, article=rng.random() < 0.5)[0]) for _ in range(2))
        size, pairs = wrapper._match(a, b)
        assert size == brute_match(a, b)
        common = wrapper.merged(a, b)
        assert json.loads(wrapper.dumps(common)) == json.loads(wrapper.dumps(wrapper.loads(wrapper.dumps(common))))
        assert wrapper._weight(common)[0] == wrapper._weight(a)[0] + wrapper._weight(b)[0]
    # long lists: equal texts hold as anchors, and nothing is matched twice
    monkeypatch.setattr(wrapper, "PAIRS", 10)
    left = parse("".join(f"<p>{i}</p>" for i in range(300)))
    right = parse("".join(f"<p>{i}</p>" for i in range(300) if i % 7) + "<p>new</p>")
    pairs = wrapper._match(left, right)[1]
    assert len({id(x) for x, _, _ in pairs}) == len(pairs) == len({id(y) for _, y, _ in pairs})
    assert sum(x.sign == y.sign for x, y, _ in pairs) == 257


@pytest.mark.parametrize("unit", ["<", "<a ", '<a "', "<!-- ", "<div>", "<b>", "<b><div>", "<script>", "</x>", "&#9", "<p>a b</p>", "<table><tr><td>x"])
def test_long_runs_of_anything(unit):
    page, start = unit * (300_000 // len(unit)), time.perf_counter()
    tree = parse(page)
    wrapper.Wrapper(wrapper.merged(tree, parse(page)), 2).text(tree)
    assert time.perf_counter() - start < 20
