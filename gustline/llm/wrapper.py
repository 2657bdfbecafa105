"""Main text of web pages by wrapper induction.

Pages of one host are trees made from one template. Simple tree matching aligns them: the nodes that all pages have are the host's
template, a text that is the same everywhere is constant, and one that varies is a slot. The slot with the bulk of the varying text is
where the host's articles are; its text, without constant nodes and without parts that are marked as menus, adverts and the like, is
the text of a page.

Templates are a partial aggregate: every task keeps one template per host for its rows, and these are merged per host, so pages are
never shuffled and a host with a third of all pages is no hot key.
"""

from __future__ import annotations

import json
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.dom import MAIN, Node, parse
from gustline.llm.tables import written
from gustline.llm.words import in_slices

# A text is constant only if so many pages of a host have it.
LEAST_PAGES = 5
# If more than this share of the slot is the same on all pages, they are copies of one article and nothing in it is template.
COPIES_SHARE = 0.3
# A slot is narrowed to a child that holds at least this share of its varying text.
SLOT_SHARE = 0.75
# Only these are parts of a page; a paragraph or list is always taken with its neighbours.
FRAMES = frozenset("body div section table tbody tr td center main article".split())
# A list of at least so many links, and little else, is a menu.
MENU_LINKS, MENU_SHARE = 4, 0.9
# Templates a task keeps at once; beyond it the least recently used one is handed on and begun anew.
TEMPLATES_HELD = 500
# Partial templates of a host are merged in so many tasks first.
MERGE_BUCKETS = 16
# Templates up to this many bytes together are broadcast; more meet the pages in a shuffle.
BROADCAST_BYTES = 32 << 20
# Children of two nodes are aligned by dynamic programming up to so many pairs; longer lists are first cut at texts that occur once in each.
PAIRS = 4_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:@]++)"


# ---- simple tree matching ----------------------------------------------------------------------------------------------


def _match(a: Node, b: Node) -> tuple[int, list]:
    """Size of the largest top-down matching of two trees that keeps order, and the matched children; (0, []) if the roots differ."""
    if a.label != b.label:
        return 0, []
    if a.tag == "#":
        return (2 if a.hash == b.hash else 1), []
    size, pairs = _match_lists(a.kids, b.kids)
    return size + 1, pairs


def _match_lists(a: list[Node], b: list[Node]) -> tuple[int, list]:
    """The best matching of two ordered lists of trees: its size and ``(node, node, matched children)`` of each matched pair."""
    size, pairs, low, high = 0, [], 0, 0
    while low < len(a) and low < len(b) and a[low].sign == b[low].sign and a[low].label == b[low].label:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high].sign == b[-1 - high].sign and a[-1 - high].label == b[-1 - high].label:
        high += 1
    for i in [*range(low), *range(-high, 0)]:
        got, below = _match(a[i], b[i])
        size += got
        pairs.append((a[i], b[i], below))
    inner_a, inner_b = a[low : len(a) - high], b[low : len(b) - high]
    if inner_a and inner_b:
        got, inner = _aligned(inner_a, inner_b)
        size += got
        pairs[low:low] = inner
    return size, pairs


def _aligned(a: list[Node], b: list[Node]) -> tuple[int, list]:
    if len(a) * len(b) > PAIRS:
        return _anchored(a, b)
    n, m = len(a), len(b)
    found = [[_match(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, above, scores = best[i + 1], best[i], found[i]
        for j in range(m):
            row[j + 1] = max(above[j + 1], row[j], above[j] + scores[j][0])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j], found[i][j][1]))
    return best[n][m], pairs[::-1]


def _anchored(a: list[Node], b: list[Node]) -> tuple[int, list]:
    """Long lists: subtrees that occur once in both, in the same order, hold; between them children are matched in turn."""
    places = {}
    for i, x in enumerate(b):
        places[x.sign] = -1 if x.sign in places else i
    seen: dict[int, int] = {}
    for x in a:
        seen[x.sign] = seen.get(x.sign, 0) + 1
    anchors, last = [], -1
    for i, x in enumerate(a):
        at = places.get(x.sign, -1)
        if at > last and seen[x.sign] == 1:
            anchors.append((i, at))
            last = at
    size, pairs, i, j = 0, [], 0, 0
    for end_i, end_j in [*anchors, (len(a), len(b))]:
        while i < end_i and j < end_j:
            if a[i].label == b[j].label:
                got, below = _match(a[i], b[j])
                size += got
                pairs.append((a[i], b[j], below))
                i, j = i + 1, j + 1
            elif end_i - i > end_j - j:
                i += 1
            else:
                j += 1
        if end_i < len(a):
            got, below = _match(a[end_i], b[end_j])
            size += got
            pairs.append((a[end_i], b[end_j], below))
        i, j = end_i + 1, end_j + 1
    return size, pairs


# ---- templates ---------------------------------------------------------------------------------------------------------


def _weight(node: Node) -> tuple[int, int]:
    """Characters, and those in links, at or below a node, outside parts that are set apart."""
    chars = linked = 0
    todo = [node]
    while todo:
        x = todo.pop()
        if not x.away:
            chars += x.chars
            linked += x.linked
            todo.extend(x.kids)
    return chars, linked


def _fold(into: Node, node: Node) -> None:
    chars, linked = _weight(node)
    if not into.away:
        into.chars += chars
        into.linked += linked


def _common(a: Node, b: Node, pairs: list) -> Node:
    """The nodes that both trees have; the rest counts as varying text of the node above it."""
    made = Node(a.tag, a.away)
    made.hash = a.hash if a.hash == b.hash else -1
    made.chars, made.linked = a.chars + b.chars, a.linked + b.linked
    matched_a, matched_b = set(), set()
    for x, y, below in pairs:
        matched_a.add(id(x))
        matched_b.add(id(y))
        made.kids.append(_common(x, y, below))
    for kids, matched in ((a.kids, matched_a), (b.kids, matched_b)):
        for kid in kids:
            if id(kid) not in matched:
                _fold(made, kid)
    made.sign = _sign(made)
    return made


def _sign(node: Node) -> int:
    if node.tag == "#":
        # two varying texts never count as the same one
        return hash((1, node.hash)) if node.hash >= 0 else hash((3, id(node)))
    return hash((2, node.label, *[kid.sign for kid in node.kids]))


def merged(a: Node, b: Node) -> Node:
    return _common(a, b, _match(a, b)[1])


def _packed(node: Node) -> list:
    return [node.tag, int(node.away), node.hash, node.chars, node.linked, [_packed(kid) for kid in node.kids]]


def _unpacked(values: list) -> Node:
    node = Node(values[0], bool(values[1]))
    node.hash, node.chars, node.linked = values[2:5]
    node.kids = [_unpacked(kid) for kid in values[5]]
    node.sign = _sign(node)
    return node


def dumps(node: Node) -> str:
    return json.dumps(_packed(node), separators=(",", ":"))


def loads(text: str) -> Node:
    return _unpacked(json.loads(text))


class _Held:
    """Templates of the hosts seen lately, with the number of their pages."""

    def __init__(self):
        self.templates: OrderedDict[str, tuple[Node, int]] = OrderedDict()
        self.done: list[tuple[str, str, int]] = []

    def add(self, host: str, tree: Node, pages: int) -> None:
        held = self.templates.pop(host, None)
        if held is not None:
            tree, pages = merged(held[0], tree), held[1] + pages
        self.templates[host] = (tree, pages)
        if len(self.templates) > TEMPLATES_HELD:
            self._hand_on(*self.templates.popitem(last=False))

    def _hand_on(self, host: str, held: tuple[Node, int]) -> None:
        self.done.append((host, dumps(held[0]), held[1]))

    def rows(self, last: bool = False):
        while last and self.templates:
            self._hand_on(*self.templates.popitem(last=False))
        if self.done:
            hosts, templates, pages = zip(*self.done, strict=True)
            self.done = []
            arrays = [pa.array(hosts, pa.string()), pa.array(templates, pa.string()), pa.array(pages, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "template", "pages"])


def _induce(batches):
    held = _Held()
    for batch in in_slices(batches, 1):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.add(host, parse(page or ""), 1)
        yield from held.rows()
    yield from held.rows(last=True)


def _merge(batches):
    held = _Held()
    for batch in in_slices(batches, 1):
        for host, template, pages in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            held.add(host, loads(template), pages)
        yield from held.rows()
    yield from held.rows(last=True)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty if it has none or is NULL."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


_TEMPLATE = "host string, template string, pages bigint"


def induce_templates(df: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``host, template, pages``: the nodes all pages of a host have, from all its pages.

    Pages without a host make up one of their own. The template is the common part of aligned trees; which of several equally large
    alignments is taken can depend on the order of pages. An empty table has no templates.
    """
    given = df.select(host_of(F.col(f"`{url_column}`")).alias("host"), F.col(f"`{html_column}`").alias("html"))
    parts = written(given.mapInArrow(_induce, _TEMPLATE).withColumn("bucket", F.spark_partition_id() % MERGE_BUCKETS), "templates")
    some = parts.repartition("host", "bucket").sortWithinPartitions("host", "pages", "template")
    some = some.select("host", "template", "pages").mapInArrow(_merge, _TEMPLATE)
    return some.repartition("host").sortWithinPartitions("host", "pages", "template").mapInArrow(_merge, _TEMPLATE)


# ---- slots -------------------------------------------------------------------------------------------------------------


def _varying(node: Node, whole: bool) -> dict[int, int]:
    """Varying characters outside links at or below each node; with ``whole`` all text varies (a page of its own)."""
    order, todo, found = [], [node], {}
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(kid for kid in x.kids if not kid.away)
    for x in reversed(order):
        own = x.chars - x.linked if whole or x.tag != "#" or x.hash < 0 else 0
        found[id(x)] = own + sum(found.get(id(kid), 0) for kid in x.kids)
    return found


def slot_of(root: Node, whole: bool = False) -> list[Node]:
    """The way from the root to the node that holds the articles.

    From the root on, the child with at least SLOT_SHARE of the varying text is followed. An article element around the place found or, if
    there is only one, inside it is the slot; else it is the nearest part around that place that also holds the first main heading.
    """
    chars = _varying(root, whole)
    way = [root]
    while True:
        kids = [kid for kid in way[-1].kids if not kid.away and kid.tag in FRAMES]
        best = max(kids, key=lambda kid: chars[id(kid)], default=None)
        if best is None or not chars[id(way[-1])] or chars[id(best)] < SLOT_SHARE * chars[id(way[-1])]:
            break
        way.append(best)
    for i, node in enumerate(way):
        if node.tag in MAIN:
            articles = [j for j, x in enumerate(way) if x.tag == "article"]
            return way[: (articles[0] if articles else i) + 1]
    inside = _outermost_main(way[-1])
    if inside and max(chars[id(x)] for x in inside) >= SLOT_SHARE * sum(chars[id(x)] for x in inside):
        return [*way, max(inside, key=lambda x: chars[id(x)])]
    for i in range(len(way) - 1, 0, -1):
        if _has_heading(way[i]):
            return way[: i + 1]
        # a part with much more than the slot is no frame of it
        if chars[id(way[i - 1])] * SLOT_SHARE > chars[id(way[-1])]:
            break
    headed = [i for i in range(len(way)) if _has_heading(way[i])]
    return way[: headed[-1] + 1] if headed and headed[-1] else way


def _outermost_main(node: Node) -> list[Node]:
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag in MAIN:
            found.append(x)
        else:
            todo.extend(kid for kid in x.kids if not kid.away)
    return found


def _has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "h1" and not x.away:
            return True
        todo.extend(kid for kid in x.kids if not kid.away)
    return False


def _constant_share(slot: Node) -> float:
    constant = total = 0
    todo = [slot]
    while todo:
        x = todo.pop()
        if x.away:
            continue
        total += x.chars
        if x.tag == "#" and x.hash >= 0:
            constant += x.chars
        todo.extend(x.kids)
    return constant / total if total else 0.0


class Wrapper:
    """A host's template with its slot, ready to be held against pages."""

    def __init__(self, template: Node | None, pages: int):
        self.template = template if pages > 1 else None
        if self.template is not None:
            # copies of one page do not vary: all their text counts
            way = slot_of(self.template, whole=_constant_share(self.template) > COPIES_SHARE)
            self.way = [id(x) for x in way]
            self.constants = pages >= LEAST_PAGES and _constant_share(way[-1]) <= COPIES_SHARE

    def text(self, page: Node) -> str:
        slot, constant = None, set()
        if self.template is not None:
            matched = {}
            todo = [(self.template, page, _match(self.template, page)[1])]
            while todo:
                x, y, below = todo.pop()
                matched[id(x)] = y
                if self.constants and x.tag == "#" and x.hash >= 0 and x.hash == y.hash:
                    constant.add(id(y))
                todo.extend(below)
            slot = matched.get(self.way[-1])
            if slot is not None and slot.tag not in MAIN and any(x is not None and x.tag in MAIN for x in map(matched.get, self.way)):
                slot = None
        if slot is None or not _weight(slot)[0]:
            slot = slot_of(page, whole=True)[-1]
        return _text(slot, constant)


def _is_menu(node: Node) -> bool:
    """A list of links and little else; only lists are looked at."""
    if node.tag not in ("ul", "ol", "dl"):
        return False
    chars, linked = _weight(node)
    return len(node.kids) >= MENU_LINKS and linked >= MENU_SHARE * chars > 0


def _text(slot: Node, constant: set[int]) -> str:
    blocks: list[str] = []
    todo = [slot]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            if id(node) not in constant:
                if node.glued and blocks:
                    blocks[-1] += node.text
                else:
                    blocks.append(node.text)
        elif not (node.away and node is not slot) and not _is_menu(node):
            todo.extend(reversed(node.kids))
    return " ".join(" ".join(blocks).split())


def _extract(batches):
    known: OrderedDict[str, Wrapper] = OrderedDict()
    for batch in in_slices(batches, 1):
        texts = []
        for host, page, template, pages in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            wrapper = known.pop(host, None)
            if wrapper is None:
                wrapper = Wrapper(loads(template) if template else None, pages or 0)
            known[host] = wrapper
            if len(known) > TEMPLATES_HELD:
                known.popitem(last=False)
            texts.append(wrapper.text(parse(page)) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(texts, pa.string())], ["_kept", "_main"])


def main_text(df: DataFrame, url_column: str = "url", html_column: str = "html", text_column: str = "main_text") -> DataFrame:
    """``df`` with the main text of each page as ``text_column``.

    Blocks are in page order, with one space between them and for any white space inside them. Equal pages of a host have equal texts. A
    page that shares its host with none is its own template. NULL or empty pages have an empty text, as have pages without any; a NULL
    address belongs to the host without a name; an empty table stays empty; very long pages are read whole; an existing column of the
    name ``text_column`` is replaced and all others are kept, whatever their names.
    """
    others = [c for c in df.columns if c != text_column]
    templates = written(induce_templates(df, url_column, html_column), "wrappers")
    size = templates.agg(F.sum(F.length("template"))).first()[0] or 0
    side = templates.select(F.col("host").alias("_host"), F.col("template").alias("_template"), F.col("pages").alias("_pages"))
    kept = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_kept")
    pages = df.select(host_of(F.col(f"`{url_column}`")).alias("_host"), F.col(f"`{html_column}`").alias("_html"), kept)
    pages = pages.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "_host", "left")
    pages = pages.select("_host", "_html", "_template", "_pages", "_kept")
    schema = T.StructType([pages.schema["_kept"], T.StructField("_main", T.StringType())])
    found = pages.mapInArrow(_extract, schema)
    return found.select(*[F.col(f"_kept.`{c}`").alias(c) for c in others], F.col("_main").alias(text_column))


def extraction_report(df: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``df(page_id, url, html)``; odd cases as in :func:`main_text`."""
    found = main_text(df.select("page_id", "url", "html"), text_column="text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
