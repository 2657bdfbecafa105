"""Fill-in-middle: whole texts are cut into units and their prefix, middle and suffix put in the order a model is trained on.

A unit is a run of ASCII letters or one other character. Where to cut and which form to take follow from a hash of the document's
id, so reruns agree. The work on texts is a chain of ``pyarrow.compute`` calls per batch: units are split into list arrays, flattened
with the index of their parent, numbered, filtered by role, put into lists again and joined; no Python code runs per unit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.words import in_slices

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

# A UTF-8 character that is no letter is one unit; the text is matched as bytes.
_UNIT = r"[A-Za-z]+|[\x00-\x7F]|[\xC0-\xFE][\x80-\xBF]*"
# This byte occurs in no UTF-8 text.
_BETWEEN = b"\xff"
# Texts are split this many bytes at a time, so that a long one does not make long arrays.
SEGMENT_BYTES = 1 << 20
# A byte that begins a character and does not go on with a run of letters.
_EDGE = re.compile(rb"[^A-Za-z\x80-\xBF]|(?<![A-Za-z])[A-Za-z]")


def _draw(id_column: str, seed: int, group: int) -> Column:
    """The ``group``-th 8-digit group of the hash of ``seed:id``, as an unsigned number. A NULL id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group - 7, 8), 16, 10).cast("bigint")


def _segments(text: bytes) -> list[bytes]:
    """Cut a long text between two units."""
    cuts, found = [0], _EDGE.search(text, SEGMENT_BYTES)
    while found:
        cuts.append(found.start())
        found = _EDGE.search(text, found.start() + SEGMENT_BYTES)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if b > a]


def _split(texts: pa.Array) -> pa.Array:
    """Units of each text as a list; the last element of each list is empty and no unit."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=b"\\0" + _BETWEEN)
    return pc.split_pattern(marked, _BETWEEN)


def _lists(values: pa.Array, parents: np.ndarray, n: int) -> pa.Array:
    """``values`` as ``n`` lists, by the ascending number of their parent."""
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(parents, np.arange(n + 1)), pa.int64()), values)


def _joined(lists: pa.Array) -> pa.Array:
    return pc.binary_join(lists, pa.scalar(b"", lists.type.value_type))


def _pieces(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of units of each binary text, and its parts before, between and after the two places (taken modulo units + 1)."""
    rows = len(texts)
    if rows == 1 and len(texts[0].as_py()) > SEGMENT_BYTES:
        return _pieces_of_long(texts[0].as_py(), int(first[0]), int(second[0]))
    lists = _split(texts)
    units = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    places = np.sort([first % (units + 1), second % (units + 1)], axis=0)
    return units, _by_role(lists, np.zeros(rows, np.int64), *places)


def _by_role(lists: pa.Array, before: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Units of each list that lie before, between and after the two places, joined; ``before`` units come ahead of a list."""
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    starts = np.searchsorted(parents, np.arange(len(lists)))
    ordinals = np.arange(len(flat)) + (before - starts)[parents]
    role = (ordinals >= low[parents]).astype(np.int8) + (ordinals >= high[parents])
    return [_joined(_lists(pc.filter(flat, pa.array(role == k)), parents[role == k], len(lists))) for k in range(3)]


def _pieces_of_long(text: bytes, first: int, second: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The same for one text, segment by segment: units are counted first, then each segment is split by itself."""
    segments = [pa.array([part], pa.large_binary()) for part in _segments(text)]
    counts = [pc.count_substring_regex(part, pattern=_UNIT)[0].as_py() for part in segments]
    units, before, found = sum(counts), 0, []
    low, high = (np.array([place % (units + 1)]) for place in (first, second))
    low, high = np.minimum(low, high), np.maximum(low, high)
    for part, count in zip(segments, counts, strict=True):
        found.append(_by_role(_split(part), np.array([before]), low, high))
        before += count
    parts = [pa.concat_arrays(of_role) for of_role in zip(*found, strict=True)]
    return np.array([units]), [_joined(_lists(x, np.zeros(len(x), np.int64), 1)) for x in parts]


def _characters(texts: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(texts.cast(pa.large_string())), pa.int64())


def _transformed(batches):
    for batch in in_slices(batches, 1):
        texts = pc.fill_null(batch.column(1), "")
        first, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        units, (prefix, middle, suffix) = _pieces(texts.cast(pa.large_binary()), first, second)
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        plain = pc.or_(batch.column(4), pc.equal(pc.binary_length(texts), 0))
        for mark in (PREFIX, SUFFIX, MIDDLE):
            plain = pc.or_(plain, pc.match_substring(texts, mark))
        spm = batch.column(5)
        p, s, m = (pa.scalar(x, pa.large_binary()) for x in marks)
        glue = pa.scalar(b"", pa.large_binary())
        psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, glue)
        spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, glue)
        output = pc.if_else(plain, texts.cast(pa.large_binary()), pc.if_else(spm, spm_text, psm_text))
        form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
        missing = pa.scalar(None, pa.int64())
        columns = [
            pa.array(units, pa.int64()),
            form,
            pc.if_else(plain, missing, _characters(prefix)),
            pc.if_else(plain, missing, _characters(middle)),
            output.cast(pa.large_string()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_row", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row of ``df``.

    ``n`` is the number of units. ``form`` is ``plain`` (the text itself), ``psm`` or ``spm``; the two places of the cut, and the form,
    follow from the id and ``seed``. A text that is empty or holds one of the marks stays plain.

    A NULL text is an empty one, a NULL id counts as an empty id and is returned as NULL, repeated rows give equal rows, an empty table
    gives an empty one, and other columns, whatever their names, are not read. Long texts are split a megabyte at a time and are never
    cut off. Bytes that are no UTF-8 are replaced as Spark's ``make_valid_utf8`` does.
    """
    draws = {i: _draw(id_column, seed, i) for i in (1, 2, 3, 4)}
    given = df.select(
        F.col(f"`{id_column}`").alias("_row"),
        F.make_valid_utf8(F.col(f"`{text_column}`")).alias("_text"),
        draws[1].alias("_first"),
        draws[2].alias("_second"),
        (draws[3] % 100 >= PLAIN_FROM).alias("_plain"),
        (draws[4] % 100 < SPM_BELOW).alias("_spm"),
    )
    schema = T.StructType(
        [
            given.schema["_row"],
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )
    return given.mapInArrow(_transformed, schema).withColumnRenamed("_row", id_column)


def _parts_of(outputs: pa.Array, first: str, second: str) -> list[pa.Array]:
    """The three parts of outputs ``first``..``second``..``<M>``..; whatever other outputs give is not used."""
    rest, parts = pc.utf8_slice_codeunits(outputs, len(first)), []
    for mark in (second, MIDDLE):
        halves = pc.split_pattern(rest, mark, max_splits=1)
        parts.append(pc.list_element(halves, 0))
        offsets = halves.offsets.to_numpy()
        # an output of another form may lack the mark: its last half is taken
        rest = halves.values.take(pa.array(offsets[1:] - 1))
    return [*parts, rest]


def _restored(batches):
    for batch in in_slices(batches, 2):
        form, output = batch.column(1), batch.column(2).cast(pa.large_string())
        prefix, suffix, middle = _parts_of(output, PREFIX, SUFFIX)
        psm = pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar("", pa.large_string()))
        suffix, prefix, middle = _parts_of(output, SUFFIX, PREFIX)
        spm = pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar("", pa.large_string()))
        text = pc.if_else(pc.equal(form, "plain"), output, pc.if_else(pc.equal(form, "spm"), spm, psm))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], output.cast(pa.string()), text.cast(pa.string())], [*batch.schema.names, "restored"])


def restore(df: DataFrame, form_column: str = "form", output_column: str = "output") -> DataFrame:
    """``df`` with the column ``restored``: the text that gave ``output``, rebuilt from it and its form alone.

    No mark can arise where a part meets a mark, because a mark begins with a character it does not end with and no part holds one. A NULL
    output gives NULL; an output of :func:`fill_in_middle` gives its whole text. A column called ``restored`` is replaced.
    """
    others = [c for c in df.columns if c not in (form_column, output_column, "restored")]
    kept = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    given = df.select(kept.alias("_kept"), F.col(f"`{form_column}`").alias("_form"), F.col(f"`{output_column}`").alias("_output"))
    schema = T.StructType([*given.schema.fields, T.StructField("restored", T.StringType())])
    back = [F.col(f"_kept.`{c}`").alias(c) for c in others]
    return given.mapInArrow(_restored, schema).select(
        *back, F.col("_form").alias(form_column), F.col("_output").alias(output_column), "restored"
    )


def fim_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """:func:`fill_in_middle` and :func:`restore` with the texts as SHA-256 of their UTF-8 bytes; odd cases as stated there."""
    made = restore(fill_in_middle(df, id_column, text_column, seed))
    return made.select(
        F.col(f"`{id_column}`"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
