"""Secret scan with multipart credential linking.

Base spans (assignments, access identifiers, long hex) are found text by text. Weak parts (temporary identifiers, client ids,
bare 40-character keys, endpoints) mean nothing alone; an interval join within scopes of ``SCOPE`` characters reports them only
where the parts that complete a credential are near.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.tables import written
from gustline.llm.words import in_slices

# The base patterns, and what follows a match to count.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
# Weak parts: role, kind, pattern.
WEAK = (
    ("identifier", "weak_id", re.compile(r"\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|\b(?i:client_?id|user(?:name)?)[\"']?\x20*[:=]\x20*[\"']?[\w.@-]{3,}")),
    ("secret", "weak_secret", re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")),
    ("endpoint", "endpoint", None),
)
# Endpoints are found from their middle: what stands before it is walked back once.
_MIDDLE = re.compile(r"://[^\s\"'<>]|(?<=[a-z]):\d{2,5}\b")
_REST = re.compile(r"[^\s\"'<>]*")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
_LAST_LABEL = re.compile(r"\.[a-z]{2,}\Z")
KINDS = (*BASE_KINDS, *(kind for _, kind, _ in WEAK))
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {kind: role for role, kind, _ in WEAK}
# Two parts belong together if at most this many characters lie between them.
SCOPE = 400
# Bits per character below which a bare 40-character word is no key.
LEAST_ENTROPY = 3.5
# What must be near a weak part of each role.
NEEDS = {"identifier": ("secret", "endpoint"), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
# Documents with spans are broadcast up to this many; more are joined by a shuffle.
BROADCAST_ROWS = 50_000

_PART = "array<struct<kind:string,start:long,end:long>>"


def entropy(word: str) -> float:
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the base secrets of a text, by start and then by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _is_word(character: str) -> bool:
    return character.isalnum() or character == "_"


def endpoints(text: str) -> list[tuple[str, int, int]]:
    """Addresses with a scheme, and hosts with a port, from left to right without overlaps.

    A scheme or host begins at the first place, behind the endpoint before, from which only its characters stand before the middle and which
    begins a word. Every character is walked over once, so the time grows with the length of the text.
    """
    found: list[tuple[str, int, int]] = []
    seen = 0
    for m in _MIDDLE.finditer(text):
        middle, is_url = m.start(), text[m.start() + 1] == "/"
        if middle < seen:
            continue
        allowed, start = _SCHEME if is_url else _HOST, middle
        while start > seen and text[start - 1] in allowed:
            start -= 1
        # what has been walked over belongs to this middle or to none
        low, seen = start, middle
        while low < middle and not (
            ("a" <= text[low] <= "z" or (not is_url and text[low].isdigit() and text[low].isascii()))
            and (low == 0 or not _is_word(text[low - 1]))
        ):
            low += 1
        if low == middle or not (is_url or _LAST_LABEL.search(text, low + 1, middle)):
            continue
        seen = _REST.match(text, m.end()).end() if is_url else m.end()
        found.append(("endpoint", low, seen))
    return found


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Parts that count only together with others."""
    found = endpoints(text)
    for _, kind, pattern in WEAK:
        for m in pattern.finditer(text) if pattern else ():
            if kind != "weak_secret" or (entropy(m[0]) >= LEAST_ENTROPY and not m[0].isalpha() and not m[0].isdigit()):
                found.append((kind, *m.span()))
    return found


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in in_slices(batches, 2):
        base, weak, digest = [], [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            spans = base_spans(text)
            parts = weak_parts(text)
            # without an identifier and a secret there is nothing to complete
            roles = {ROLES[s[0]] for s in (*spans, *parts)}
            if not {"identifier", "secret"} <= roles:
                parts = []
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            weak.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in parts])
            digest.append(hashlib.sha256(spans_text(spans).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(base, kind), pa.array(weak, kind), pa.array(digest)],
            names=["id", "text_key", "base", "weak", "base_sha256"],
        )


def _linked(found: DataFrame) -> DataFrame:
    """Weak parts whose complementary parts are near: ``row, kind, start, end``.

    The interval join meets on bins as wide as the scope: a part is looked for in its own and the two neighbouring bins, so a
    bin holds a bounded number of parts whatever the length of the text.
    """
    rows = found.where(F.size("weak") > 0)
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = rows.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.kind", "p.start", "p.end")
    parts = parts.withColumn("role", role[F.col("kind")])
    # from the bin of its first to that of its last character, and one more on either side
    first, last = (F.col("start") / SCOPE).cast("long"), (F.col("end") / SCOPE).cast("long")
    near = parts.select("row", F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
                        F.explode(F.sequence(first - 1, last + 1)).alias("bin"))
    weak = parts.where(F.col("kind").isin([kind for _, kind, _ in WEAK])).withColumn("bin", F.explode(F.sequence(first, last)))
    met = weak.join(near, ["row", "bin"]).where(
        (F.col("o_start") - F.col("end") <= SCOPE) & (F.col("start") - F.col("o_end") <= SCOPE)
        # a part does not complete itself, nor one that it overlaps
        & ((F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start")))
    )
    has = {r: F.max((F.col("o_role") == r).cast("int")).alias(f"has_{r}") for r in ("identifier", "secret", "endpoint")}
    met = met.groupBy("row", "kind", "role", "start", "end").agg(*has.values())
    enough = F.lit(False)
    for r, needs in NEEDS.items():
        complete = F.col("role") == r
        for need in needs:
            complete = complete & (F.col(f"has_{need}") == 1)
        enough = enough | complete
    return met.where(enough).select("row", "kind", "start", "end")


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column``, ``text_key`` (hash of the text), ``base``, ``added``: arrays of
    ``kind, start, end`` in code points, end exclusive, by start and then by kind; and ``base_sha256``.

    A NULL or empty text has no span. Repeated rows are rows of their own. An empty table gives an empty result. Other columns, whatever
    their names, are not read. Texts are scanned whole, in a time that grows with their length.
    """
    texts = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found = texts.select("id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _scan, f"id long, text_key long, base {_PART}, weak {_PART}, base_sha256 string"
    )
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    linked = _linked(found)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    added = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "kind", "end"))).alias("x"))
    added = added.select("row", F.transform("x", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))).alias("added"))
    rows = found.join(added, "row", "left")
    return rows.select(
        F.col("id").alias(id_column), "text_key", "base", F.coalesce("added", F.array().cast(_PART)).alias("added"), "base_sha256"
    )


def secret_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of :func:`find_secrets` as text: ``n_assign, n_access, n_hex, base_sha256, spans``."""
    found = find_secrets(df, id_column, text_column)
    of_kind = lambda kind: lambda p: p["kind"] == kind
    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    line = lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))
    ordered = F.sort_array(
        F.transform(
            F.concat("base", "added"),
            lambda p: F.struct(p["start"].alias("start"), F.array_position(kinds, p["kind"]).alias("o"),
                               p["kind"].alias("kind"), p["end"].alias("end")),
        )
    )
    return found.select(id_column, *count, "base_sha256", F.array_join(F.transform(ordered, line), ",").alias("spans"))


def _masked(names: list[str], text_at: int):
    def run(batches):
        for batch in in_slices(batches, text_at):
            texts = []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    out, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            out += [text[at : s["start"]], f"[{s['kind']}]"]
                        at = max(at, s["end"])
                    text = "".join([*out, text[at:]])
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def mask_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, and ``length_column`` (if there is one) set anew.

    Every row stays. Overlapping spans are replaced once, under the kind of the first. A text without a span is untouched.
    """
    found = find_secrets(df, id_column, text_column).where(F.size("base") + F.size("added") > 0)
    found = written(
        found.select(F.col(id_column).alias("_secret_id"), F.col("text_key").alias("_secret_key"),
                     F.concat("base", "added").alias("_secret_spans")).dropDuplicates(["_secret_id", "_secret_key"]),
        "secret-spans",
    )
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = df.join(
        side,
        F.col(f"`{id_column}`").eqNullSafe(F.col("_secret_id")) & (F.xxhash64(F.col(f"`{text_column}`").cast("string")) == F.col("_secret_key")),
        "left",
    )
    names = df.columns
    rows = rows.select(*[F.col(f"`{c}`") for c in names], "_secret_spans")
    masked = rows.mapInArrow(_masked(names, names.index(text_column)), df.schema)
    if length_column in names:
        masked = masked.withColumn(length_column, F.length(text_column).cast(df.schema[length_column].dataType))
    return masked
