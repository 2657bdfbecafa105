"""Best-fit packing of tokenised documents into sequences of fixed capacity, in bulk-synchronous steps.

1. One pass over the texts gives the token ids of each document plus the end id, cut into pieces of at most ``capacity`` tokens
   (the first piece takes the remainder). A full piece is a sequence by itself.
2. Pieces are taken in size classes from large to small. In a superstep the class's pieces and all gaps that can hold one are
   range-sorted by size together. Each range is swept from large to small: a piece goes to the smallest gap that holds it, and
   what is left of the gap is a gap again. Pieces that found no gap in their range are matched with the gaps left over in the
   ranges above: only counts per range reach the driver, which deals leftover pieces to the nearest range above by rank; piece
   rank r takes gap slot r there.
3. Gaps are updated. When a superstep places nothing, the rest of the class opens new sequences, filled range by range by best
   fit, and the next class follows.

A piece ends in exactly one sequence; offsets are running sums inside a sequence, which holds at most ``capacity`` tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.tables import written
from gustline.llm.words import in_slices

CAPACITY = 2048
END_ID = 0
# Upper bounds of the size classes as parts of the capacity, from large to small. Above one half no two pieces share a sequence.
CLASS_PARTS = (2, 3, 6, 20)
# Pieces sorted into one range of a sweep.
RANGE_ROWS = 50_000

_encoders: dict[str, object] = {}


def _whole(vocabulary: str):
    """The vocabulary's own tokenizer; kept per worker."""
    if vocabulary not in _encoders:
        from tokenizers import Tokenizer

        _encoders[vocabulary] = Tokenizer.from_file(vocabulary)
    return _encoders[vocabulary]


def _ranks(path: str):
    """The ranks file beside a vocabulary as an encoding; kept per worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[path]


def _added(vocabulary: str):
    """Pattern of the vocabulary's added tokens, longest first, and their ids; kept per worker."""
    key = f"{vocabulary} added"
    if key not in _encoders:
        with open(vocabulary, encoding="utf-8") as file:
            tokens = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}
        pattern = "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))
        _encoders[key] = (re.compile(f"({pattern})") if tokens else None, tokens)
    return _encoders[key]


def encoder(vocabulary: str):
    """``encode(text) -> ids`` for a byte-level BPE vocabulary, as its own tokenizer gives them by default.

    The ranks file beside the vocabulary (same name, ``.tiktoken``) holds the same merges and gives the same ids in a fifth of the time;
    texts are split at the vocabulary's added tokens, which stay whole, before it is asked. The vocabulary itself is read where that file is
    missing or a text is too much for it.
    """
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    slow = lambda text: _whole(vocabulary).encode(text, add_special_tokens=False).ids
    if not os.path.exists(ranks):
        return slow

    def encode(text: str) -> list[int]:
        # very long runs of one kind take the regex engine of the fast one too deep
        if len(text) > 1_000_000:
            return slow(text)
        try:
            pattern, tokens = _added(vocabulary)
            if pattern is None or not pattern.search(text):
                return _ranks(ranks).encode_ordinary(text)
            ids: list[int] = []
            for part in pattern.split(text):
                ids += [tokens[part]] if part in tokens else _ranks(ranks).encode_ordinary(part)
            return ids
        except BaseException as error:  # a panic in the native code
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document: full ones, the first takes the remainder.

    >>> cut(5, 2)
    [(0, 1), (1, 2), (3, 2)]
    """
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _tokenise(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = encoder(vocabulary)
        for batch in in_slices(batches, 1):
            out: dict[str, list] = {k: [] for k in ("doc", "piece", "start", "length", "crc", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.asarray(encode(text or ""), "<u4"), np.uint32(end_id))
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    out["doc"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["crc"].append(zlib.crc32(own.tobytes()))
                    out["ids"].append(own.astype(np.int32) if with_ids else None)
            columns = [pa.array(out["doc"], batch.schema.field(0).type), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]
            names = ["doc", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(
    df: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """``doc, piece, start, length, ids_crc32`` and, if asked for, ``ids``, of all documents.

    A NULL or empty text is one piece that holds the end id. Repeated rows are documents of their own. Very long texts are tokenised whole
    and cut into as many pieces as they need. A NULL id stays NULL. An empty table gives an empty result. Other columns, whatever their
    names, are not read.
    """
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(_tokenise(vocabulary, capacity, end_id, with_ids), schema)


def best_fit(sizes: np.ndarray, gaps: np.ndarray, capacity: int, opens: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One sweep: for each piece (sizes descending) the gap it goes to or -1, and what is left of each gap.

    The smallest gap that holds a piece takes it; what is left of it takes part again. With ``opens`` a piece that no gap holds
    opens a gap of the whole capacity, numbered after the given ones.

    >>> best_fit(np.array([5, 3, 2]), np.array([6, 5]), 10)
    (array([1, 0, 0]), array([1, 0]))
    >>> best_fit(np.array([6, 5, 4]), np.array([], int), 10, opens=True)
    (array([0, 1, 0]), array([0, 5]))
    """
    left = gaps.tolist()
    by_size: dict[int, list[int]] = {}
    present = 0  # a bit for every size that some gap has
    for at, gap in enumerate(left):
        by_size.setdefault(gap, []).append(at)
        present |= 1 << gap
    to = np.full(len(sizes), -1, np.int64)
    for i, size in enumerate(sizes.tolist()):
        above = present >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            at = by_size[gap].pop()
            if not by_size[gap]:
                present ^= 1 << gap
        elif opens:
            gap, at = capacity, len(left)
            left.append(gap)
        else:
            continue
        to[i] = at
        left[at] = rest = gap - size
        if rest:
            by_size.setdefault(rest, []).append(at)
            present |= 1 << rest
    return to, np.array(left, np.int64)


def _columns(batches, n: int) -> list[np.ndarray] | None:
    """The first ``n`` columns of all batches of a task, or None if there is no row."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(n)] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _sweep(capacity: int, low: int):
    """Sweep one range: rows ``is_piece, id, size`` in, ``part, is_piece, id, size, to, rank`` out.

    Of a piece ``to`` is its sequence or -1, of a gap ``size`` is what is left. Leftover pieces are ranked in the order of the
    sweep, untouched gaps from the smallest; other rows have rank -1. One more row (``is_piece`` NULL) counts leftover pieces
    (``id``), untouched gaps (``size``) and gaps with more than ``low`` left (``to``).
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = _columns(batches, 3)
        if rows is None:
            return
        is_piece, ids, sizes = rows
        is_piece = is_piece.astype(bool)
        order = np.lexsort([ids[is_piece], -sizes[is_piece]])
        piece_ids, piece_sizes = ids[is_piece][order], sizes[is_piece][order]
        order = np.lexsort([ids[~is_piece], sizes[~is_piece]])
        gap_ids, gap_sizes = ids[~is_piece][order], sizes[~is_piece][order]
        to, left = best_fit(piece_sizes, gap_sizes, capacity)
        free, untouched = to < 0, left == gap_sizes
        own = np.full(len(to), -1, np.int64)
        own[~free] = gap_ids[to[~free]]
        none = np.full(len(gap_ids), -1, np.int64)
        for flag, i, size, target, ranked in (
            (True, piece_ids, piece_sizes, own, free),
            (False, gap_ids, left, none, untouched),
            (None, [free.sum()], [untouched.sum()], [(left > low).sum()], np.zeros(1, bool)),
        ):
            n = len(i)
            columns = [np.full(n, part, np.int64), pa.array([flag] * n, pa.bool_()), i, size, target,
                       np.where(ranked, np.cumsum(ranked) - 1, -1)]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
                names=["part", "is_piece", "id", "size", "to", "rank"],
            )

    return run


def _deal(left: list) -> list[tuple[int, int, int, int, int]]:
    """``part, first rank, count, from part, first slot``: leftover pieces of each range, large sizes first, take the leftover
    gaps of the nearest ranges above them. One entry per range and source at most."""
    stack: list[list[int]] = []
    out = []
    for part, pieces, gaps in sorted(left):
        rank, need = 0, pieces
        while need and stack:
            above, used, free = stack[-1]
            take = min(need, free)
            out.append((part, rank, take, above, used))
            rank, need = rank + take, need - take
            stack[-1] = [above, used + take, free - take]
            if not stack[-1][2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps])
    return out


def _superstep(pieces: DataFrame, gaps: DataFrame, rows: int, capacity: int, low: int):
    """Placed pieces (``id, size, to``), pieces left over and gaps left (``id, size``), and the numbers of pieces left over and of
    gaps that may hold another piece. Three shuffles: the sweep's ranges, and leftover pieces and gaps by rank."""
    spark = pieces.sparkSession
    both = pieces.select(F.lit(True).alias("is_piece"), "id", "size").unionByName(
        gaps.select(F.lit(False).alias("is_piece"), "id", "size")
    )
    ranges = max(1, -(-rows // RANGE_ROWS))
    swept = both.repartitionByRange(ranges, F.desc("size"), "is_piece", "id").mapInArrow(
        _sweep(capacity, low), "part long, is_piece boolean, id long, size long, to long, rank long"
    )
    swept = written(swept, "pack-sweep")
    placed = swept.where("is_piece and to <> -1").select("id", "size", "to")
    rest, free = swept.where("is_piece and to = -1"), swept.where("not is_piece")
    # one row per range
    counts = [(r["part"], r["id"], r["size"], r["to"]) for r in swept.where("is_piece is null").collect()]
    waiting, able = sum(c[1] for c in counts), sum(c[3] for c in counts)
    dealt = _deal([c[:3] for c in counts])
    if not dealt:
        return placed, rest.select("id", "size"), free.select("id", "size").where("size > 0"), waiting, able
    # an interval of ranks becomes one of slots; at most two rows per range
    side = spark.createDataFrame(dealt, "_part long, first long, count long, from_part long, slot long")
    inside = (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    # rows that cannot meet (kind 1 and 2) go by their id, so they are spread over all tasks
    slot = F.col("slot") + F.col("rank") - F.col("first")
    rest = rest.join(F.broadcast(side), inside, "left").select(
        "id", "size", F.coalesce("from_part", F.lit(-1)).alias("part"), F.coalesce(slot, "id").alias("rank"),
        F.when(slot.isNull(), 1).otherwise(0).alias("kind"),
    )
    offered = F.col("rank") >= 0
    free = free.select(
        F.col("id").alias("gap"), F.col("size").alias("gap_size"), "part", F.when(offered, F.col("rank")).otherwise(F.col("id")).alias("rank"),
        F.when(offered, 0).otherwise(2).alias("kind"),
    )
    met = written(rest.join(free, ["part", "rank", "kind"], "full").select("id", "size", "gap", "gap_size"), "pack-met")
    placed = placed.unionByName(met.where("id is not null and gap is not null").select("id", "size", F.col("gap").alias("to")))
    gap_left = F.col("gap_size") - F.coalesce("size", F.lit(0))
    gaps = met.where("gap is not null").select(F.col("gap").alias("id"), gap_left.alias("size")).where("size > 0")
    return placed, met.where("gap is null").select("id", "size"), gaps, waiting - sum(d[2] for d in dealt), able


def _open(number: int, capacity: int):
    """New sequences for the pieces of a range, by best fit among themselves: ``id, size, to`` per piece, and ``id`` NULL with what
    is left of each sequence. Sequences get numbers of their own below -1."""

    def run(batches):
        from pyspark import TaskContext

        rows = _columns(batches, 2)
        if rows is None:
            return
        ids, sizes = rows
        order = np.lexsort([ids, -sizes])
        to, left = best_fit(sizes[order], np.zeros(0, np.int64), capacity, opens=True)
        first = (number << 56) + (TaskContext.get().partitionId() << 36)
        names = ["id", "size", "to"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(sizes[order]), pa.array(-2 - (first + to))], names=names)
        opened = -2 - (first + np.arange(len(left)))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array(left), pa.array(opened)], names=names)

    return run


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``id, size, to``: the sequence of each piece of a fixed table ``id`` (unique, not negative), ``size`` (1 to ``capacity``)."""
    full = pieces.where(F.col("size") * 2 > capacity)
    # above one half every piece opens a sequence, named after the piece
    out = [full.select("id", "size", F.col("id").alias("to"))]
    gaps = full.where(F.col("size") < capacity).select("id", (F.lit(capacity) - F.col("size")).alias("size"))
    bounds = [capacity // p for p in CLASS_PARTS]
    low_of = F.coalesce(*[F.when(F.col("size") > b, F.lit(b)) for b in bounds[1:]], F.lit(0))
    counted = pieces.where(F.col("size") * 2 <= capacity).groupBy(low_of.alias("low")).agg(F.count("*").alias("n")).collect()
    counted = {r["low"]: r["n"] for r in counted}
    for number, (high, low) in enumerate(zip(bounds, [*bounds[1:], 0], strict=True)):
        waiting = counted.get(low, 0)
        if not waiting:
            continue
        rest = pieces.where((F.col("size") > low) & (F.col("size") <= high))
        able, others = gaps.where(F.col("size") > low), gaps.where(F.col("size") <= low)
        n_able = able.count()
        while waiting and n_able:
            before = waiting
            placed, rest, able, waiting, n_able = _superstep(rest, able, waiting + n_able, capacity, low)
            out.append(placed)
            others = others.unionByName(able.where(F.col("size") <= low))
            able = able.where(F.col("size") > low)
            if waiting == before:
                break
        gaps = others.unionByName(able)
        if waiting:
            ranges = max(1, -(-waiting // RANGE_ROWS))
            opened = rest.select("id", "size").repartitionByRange(ranges, F.desc("size"), "id")
            opened = written(opened.mapInArrow(_open(number, capacity), "id long, size long, to long"), "pack-open")
            out.append(opened.where("id is not null"))
            gaps = gaps.unionByName(opened.where("id is null and size > 0").select(F.col("to").alias("id"), "size"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with ``sequence_id`` and ``offset``.

    No sequence holds more than ``capacity`` tokens, offsets are gapless from 0. A length of 0, NULL or above ``capacity`` is an
    error of the caller: such rows come back without a sequence. An empty table gives an empty result.
    """
    fixed = written(pieces.withColumn("_piece_row", F.monotonically_increasing_id()), "pack-pieces")
    sized = fixed.select(F.col("_piece_row").alias("id"), F.col("length").alias("size")).where(
        (F.col("length") > 0) & (F.col("length") <= capacity)
    )
    found = assign(sized, capacity)
    before = Window.partitionBy("to").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        F.col("id").alias("_piece_row"), F.col("to").alias("sequence_id"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
    )
    return fixed.join(found, "_piece_row", "left").drop("_piece_row")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from :func:`pack` of pieces with ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def packing_report(df: DataFrame, vocabulary: str, **settings) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; odd cases as in :func:`token_pieces`."""
    pieces = token_pieces(df, vocabulary, with_ids=False, **settings)
    return pack(pieces, settings.get("capacity", CAPACITY)).withColumnRenamed("doc", settings.get("id_column", "doc_id"))
