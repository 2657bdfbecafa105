"""Records written after a given XML template, compiled once into one native expression."""

from __future__ import annotations

from collections.abc import Mapping
from xml.dom import minidom

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column as ColumnType

from gustline.functions.text import html_escape
from gustline.functions.times import file_key


def _attributes(element) -> str:
    found = [element.attributes.item(i) for i in range(element.attributes.length)]
    quoted = ((node.name, node.value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")) for node in found)
    return "".join(f' {name}="{value}"' for name, value in quoted)


def _open(element) -> str:
    return f"<{element.tagName}{_attributes(element)}>"


def _inside(element, path: str, columns: Mapping[str, Column], fixed: bool) -> list[str | Column]:
    """What stands between the tags of an element: texts and columns in the template's order."""
    made: list[str | Column] = []
    space = ""
    for node in element.childNodes:
        if node.nodeType == node.ELEMENT_NODE:
            made.append(_element(node, f"{path}{node.tagName}", columns, fixed, space))
            space = ""
        elif node.nodeType == node.TEXT_NODE and not node.data.strip():
            # white space goes with the element behind it, so a left-out element leaves no empty line
            space = node.data
        else:
            made.append(space + node.toxml())
            space = ""
    return [*made, space]


def _joined(parts: list[str | Column]) -> Column:
    return F.concat(*[x if isinstance(x, ColumnType) else F.lit(x) for x in parts if not (isinstance(x, str) and x == "")], F.lit(""))


def _element(element, path: str, columns: Mapping[str, Column], fixed: bool, space: str) -> Column:
    start, end = space + _open(element), f"</{element.tagName}>"
    nested = any(child.nodeType == child.ELEMENT_NODE for child in element.childNodes)
    if path in columns and not nested:
        value = columns[path].cast("string")
        return F.when(F.trim(value) != "", F.concat(F.lit(start), html_escape(value), F.lit(end))).otherwise("")
    if nested:
        # a nested element stands while its own column, if it has one, has a value and while something is left in it
        inner = _joined(_inside(element, f"{path}/", columns, fixed))
        stays = columns[path].isNotNull() if path in columns else F.lit(True)
        return F.when(stays & (F.trim(F.regexp_replace(inner, r"\s+", " ")) != ""), F.concat(F.lit(start), inner, F.lit(end))).otherwise("")
    text = "".join(child.toxml() for child in element.childNodes)
    return F.lit(f"{start}{text}{end}" if fixed and text.strip() else "")


def compile_template(template: str, columns: Mapping[str, Column | str], keep_fixed: bool = True) -> Column:
    """One column with the whole document for each row, from the text of a template.

    ``columns`` maps paths below the root (``temp_f``, ``image/url``) to columns. Order, attributes, namespaces, processing instructions
    and white space are the template's. An element whose column is NULL or blank is left out with the space before it; one without a
    column keeps the template's text, or is left out if ``keep_fixed`` is false or it has none; an element left without children goes.
    Paths that the template does not have are an error.
    """
    document = minidom.parseString(template.encode("utf-8") if isinstance(template, str) else template)
    root = document.documentElement
    named = {path: F.col(c) if isinstance(c, str) else c for path, c in columns.items()}
    missing = set(named) - set(_paths(root, ""))
    if missing:
        raise ValueError(f"not in the template: {', '.join(sorted(missing))}")
    before = "".join(node.toxml() + "\n" for node in document.childNodes if node is not root and _ahead(node, root, document))
    after = "".join("\n" + node.toxml() for node in document.childNodes if node is not root and not _ahead(node, root, document))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n' if document.version or document.encoding else ""
    return _joined([head + before + _open(root), *_inside(root, "", named, keep_fixed), f"</{root.tagName}>{after}"])


def _paths(element, above: str):
    for child in element.childNodes:
        if child.nodeType == child.ELEMENT_NODE:
            yield above + child.tagName
            yield from _paths(child, f"{above}{child.tagName}/")


def _ahead(node, root, document) -> bool:
    nodes = list(document.childNodes)
    return nodes.index(node) < nodes.index(root)


def template_records(df: DataFrame, template: str, columns: Mapping[str, Column | str], station: str, ts: str, out: str = "xml") -> DataFrame:
    """``df`` with the document of each row as ``out`` and the name of its file as ``file_name``; no job and no shuffle."""
    return df.withColumns({out: compile_template(template, columns), "file_name": file_key(station, ts, "xml")})
