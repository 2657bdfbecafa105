"""Trees of HTML pages: a forgiving parser whose time grows with the length of the page, whatever it holds."""

from __future__ import annotations

import html
import re

import xxhash

# Elements by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr img".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# Elements that never hold the text of an article.
ASIDE = frozenset(
    "nav footer aside form button select option datalist input label menu dialog template object embed applet svg canvas video audio map "
    "header".split()
)
# Words of class, id and role that mark such parts; a word may end in s.
ASIDE_WORDS = frozenset(
    "ad advert advertisement advertising advertorial adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb footer header masthead topbar toolbar comment commentlist disqus reply respond notice cookie consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup signin login search searchbox share sharing social related recommended recommendation "
    "widget pagination pager alert contentinfo complementary skip".split()
)
# These words count outside an article only: its own header is its head.
HEADS = frozenset(["header", "headers"])
MAIN = frozenset(["article", "main"])
# An element that begins ends an open one of these.
ENDS = {
    **dict.fromkeys(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
        "p pre section table ul".split(),
        ("p",),
    ),
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
}
# An open element of the first kind is not looked for beyond one of these.
FENCES = frozenset("ul ol dl table body html article section div form".split())
# Deeper elements are taken as part of the one above; their text stays.
DEEPEST = 120
# So many open inline elements of a tag are remembered.
OPEN_INLINE = 8

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BIG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9A-Fa-f]{8,}+);?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FILLED = re.compile(r"\S")


class Node:
    """An element, or a run of text (``tag`` is ``#``). ``hash`` tells texts apart; -1 stands for texts that differ from page to page.

    ``chars`` and ``linked`` count the characters of a run of text, and those inside links; on an element of a template they count the
    text below it that no node of the template stands for. ``away`` marks menus, adverts and the like.
    """

    __slots__ = ("tag", "label", "kids", "text", "glued", "hash", "chars", "linked", "away", "sign")

    def __init__(self, tag: str, away: bool = False):
        self.tag, self.away, self.label = tag, away, tag + "!" if away else tag
        self.kids, self.text, self.glued = [], None, False
        self.hash = self.chars = self.linked = self.sign = 0


def _words(value: str):
    """Words of an attribute, also without their last s, and two neighbours written as one."""
    found = [word.lower() for word in _WORD.findall(value)]
    for word in [*found, *map("".join, zip(found, found[1:], strict=False))]:
        yield word
        if word.endswith("s"):
            yield word[:-1]


def _is_away(tag: str, rest: str) -> str:
    """``hidden``, ``head`` (a header) or ``part`` if the element is set apart by its tag, class, id, role or style, else nothing."""
    found = ("head" if tag == "header" else "part") if tag in ASIDE else ""
    if not rest or rest.isspace() or tag in ("html", "body"):
        return found
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            return "hidden"
        if name in ("class", "id", "role") and found != "part":
            marks = ASIDE_WORDS.intersection(_words(value))
            found = "part" if marks - HEADS else "head" if marks else found
    return found


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_BIG_REFERENCE.sub("�", text))


class _Builder:
    def __init__(self):
        self.root = Node("html")
        # tag, node (None for inline elements that leave no node)
        self.stack: list[tuple[str, Node | None]] = [("html", self.root)]
        self.current, self.open = self.root, {"html": 1}
        self.broken, self.links, self.depth = True, 0, 1

    def text(self, piece: str) -> None:
        kids = self.current.kids
        if kids and kids[-1].tag == "#" and not self.broken:
            leaf = kids[-1]
        elif not _FILLED.search(piece):
            # white space alone makes no run, but it parts words
            if not self.broken:
                self.broken = True
            return
        else:
            leaf = Node("#")
            leaf.text, leaf.glued = [], not self.broken
            kids.append(leaf)
            self.broken = False
        leaf.text.append(piece)
        if self.links:
            leaf.linked += len(piece)

    def _popped(self, entry: tuple[str, Node | None]) -> None:
        tag, node = entry
        self.open[tag] -= 1
        self.depth -= node is not None
        if tag == "a":
            self.links -= 1

    def _settle(self) -> None:
        for _, node in reversed(self.stack):
            if node is not None:
                self.current = node
                return

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.broken = True
        if not self.open.get(tag) or tag == "html":
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        if tag in INLINE and any(node is not None for _, node in self.stack[at + 1 :]):
            # blocks opened inside an inline element stay open
            if self.stack[at][1] is None:
                self._popped(self.stack.pop(at))
            return
        for entry in self.stack[at:]:
            self._popped(entry)
        del self.stack[at:]
        self._settle()

    def start(self, tag: str, rest: str) -> None:
        if tag == "html":
            return
        if tag == "body" and self.open.get("body"):
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self.end("head")
        if tag not in INLINE:
            self.broken = True
            for ended in ENDS.get(tag, ()):
                if self.open.get(ended):
                    self._end_open(ended)
        elif tag == "a" and self.links:
            self.end("a")
        if tag in VOID:
            return
        why = _is_away(tag, rest)
        node = None
        if tag not in INLINE or why:
            if self.depth >= DEEPEST:
                return
            self.depth += 1
            node = Node(tag, bool(why))
            node.text = why
            self.current.kids.append(node)
            self.current = node
        elif self.open.get(tag, 0) >= OPEN_INLINE:
            return
        if tag == "a":
            self.links += 1
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end_open(self, tag: str) -> None:
        """End the nearest open ``tag`` unless a container was opened since."""
        for name, _ in reversed(self.stack):
            if name == tag:
                self.end(tag)
                return
            if name in FENCES:
                return


def parse(page: str) -> Node:
    """The tree of a page. Comments, scripts and styles leave no nodes; unclosed and misnested elements are mended."""
    build, at, n = _Builder(), 0, len(page)
    quotes = True
    while at < n:
        low = page.find("<", at)
        if low < 0:
            build.text(page[at:])
            break
        if low > at:
            build.text(page[at:low])
        if page.startswith("<!--", low):
            if page.startswith((">", "->"), low + 4):
                at = page.index(">", low) + 1
                continue
            end = page.find("-->", low + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), low):
            end = page.find(">", low)
            at = n if end < 0 else end + 1
            continue
        if page.startswith("</", low) and not page[low + 2 : low + 3].isalpha():
            end = page.find(">", low)
            at = n if end < 0 else end + 1
            continue
        if not ("a" <= page[low + 1 : low + 2].lower() <= "z" and page[low + 1 : low + 2].isascii()) and page[low + 1 : low + 2] != "/":
            build.text("<")
            at = low + 1
            continue
        found = _TAG.match(page, low) if quotes else None
        if found is None:
            # a quote is never closed: from here on quotes protect nothing, so no part of the page is searched twice
            quotes = False
            found = _PLAIN_TAG.match(page, low)
            if found is None:
                break
        tag, at = found[2].lower(), found.end()
        if found[1]:
            if tag in ("br", "p") and not build.open.get(tag):
                build.broken = True
            else:
                build.end(tag)
            continue
        build.start(tag, found[3])
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if closing is None:
                break
            at = page.find(">", closing.start())
            at = n if at < 0 else at + 1
            build.end(tag)
    _finish(build.root, False)
    return build.root


def _finish(root: Node, inside: bool) -> None:
    """Settle what is set apart, read the texts and sign subtrees, children before parents."""
    order, todo = [], [(root, inside)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in MAIN
        todo.extend((kid, inside) for kid in node.kids)
    holds: set[int] = set()
    for node, inside in reversed(order):
        if node.tag == "#":
            raw = decoded("".join(node.text))
            node.text = raw
            shown = " ".join(raw.split())
            node.chars = len(shown)
            node.linked = min(node.linked, node.chars)
            node.hash = xxhash.xxh3_64_intdigest(shown) >> 2
            node.sign = hash((1, node.hash))
            continue
        main = node.tag in MAIN or any(id(kid) in holds for kid in node.kids)
        if node.away and node.text != "hidden":
            # a part that holds the article is a frame around it; the header of an article is its head
            if (main and node.tag not in MAIN) or (inside and node.text == "head"):
                node.away, node.label = False, node.tag
        if main and not node.away:
            holds.add(id(node))
        node.text = None
        node.sign = hash((2, node.label, *[kid.sign for kid in node.kids]))
