"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its shingle set and its band keys. The
   signature needs two permutations only: the first spreads the shingles over a ring of 2**32 places, the second is applied
   after a circular shift by k for coordinate k.
2. Documents with the same set are one node: copies cost one row each from here on.
3. Nodes that share a band key are candidates. A key's nodes are not paired off with each other: in each round a few *pivots*
   per key (the nodes that share most keys with others) are compared with the rest. Each node is then labelled with the most
   popular node it is linked to, and only keys whose other nodes have different labels stay; their pivots have been compared
   with all of the key and leave it. The nodes of keys that still have more than ``LARGE_KEY`` nodes after the first round, mostly
   texts that share a common passage, meet again under their rarest shingles instead (see ``_by_rare_shingles``), where every
   pair of enough similarity meets. Rounds go on, with more pivots, until no key is open: no key's size is capped.
4. A candidate pair is compared on the full shingle sets of both texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.components import connected_components
from gustline.llm.tables import BROADCAST_IDS, discard, without_ids, written
from gustline.llm.words import Shingles, in_slices, mix32, mix64, numbered

SHINGLE = 5
SIMILARITY_PERCENT = 75
# A pair of similarity 0.75 misses all of 32 bands of 4 coordinates with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
FIRST_PIVOTS, MORE_PIVOTS = 1, 64
# Nodes above which a key that is open after the first round is replaced by the rarest shingles of its nodes.
LARGE_KEY = 48
# Shingles times coordinates worked on at once.
BLOCK = 1 << 16

# Low bits of each coordinate that make up a node's sketch, in 64-bit words. Two sketches agree in a coordinate with probability
# (1 + 3 J) / 4; at similarity 0.75 fewer than SKETCH_SHARE of 128 agree with probability 2e-6, and such pairs are not compared.
SKETCH_BITS, SKETCH_SHARE = 2, 0.656

# Bits of a node's parity sketch: a shingle flips one of them, so two sketches differ in at most as many bits as there are shingles
# in one set only. Pairs that differ in more than the similarity allows are not compared; no link is lost by it.
PARITY_BITS = 512

_SPREAD = np.uint64(0x9FB21C651E98DF25)


class Signer:
    """Circulant MinHash signatures, band keys and sketches of non-empty sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
        self.row_weights, self.band_marks = numbered(rows, 4), numbered(bands, 5)
        self.step = max(1, BLOCK // (bands * rows))
        per_word = 64 // SKETCH_BITS
        self.places = (np.arange(bands * rows, dtype=np.uint64) % np.uint64(per_word)) * np.uint64(SKETCH_BITS)
        self.cuts = np.arange(0, bands * rows, per_word)

    def signature(self, shingle_set: np.ndarray) -> np.ndarray:
        ring = (mix64(shingle_set * _SPREAD) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(ring), self.step):
            np.minimum(least, mix32(ring[None, i : i + self.step] + self.shifts).min(axis=1), out=least)
        return least

    def band_keys(self, least: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different between bands."""
        totals = (least.reshape(self.bands, self.rows) * self.row_weights).sum(axis=1, dtype=np.uint64)
        return mix64(totals + self.band_marks).view(np.int64)

    def sketch(self, least: np.ndarray) -> np.ndarray:
        low = least.astype(np.uint64) & np.uint64((1 << SKETCH_BITS) - 1)
        return np.bitwise_or.reduceat(low << self.places, self.cuts).view(np.int64)


def parity(shingle_set: np.ndarray) -> np.ndarray:
    """The parity sketch in 64-bit words."""
    places = (shingle_set % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def set_fingerprint(shingle_set: np.ndarray) -> tuple[int, int]:
    both = np.array(
        [shingle_set.sum(dtype=np.uint64), mix64(shingle_set ^ _SPREAD).sum(dtype=np.uint64)], np.uint64
    ).view(np.int64)
    return int(both[0]), int(both[1])


def _profile(size: int, bands: int, rows: int):
    def run(batches):
        signer, shingles = Signer(bands, rows), Shingles(size)
        for batch in in_slices(batches, 1):
            n, high, low, keys, sketches = [], [], [], [], []
            for found in shingles.sets(batch.column(1)):
                n.append(len(found))
                a = b = own = sketch = None
                if len(found):
                    a, b = set_fingerprint(found)
                    least = signer.signature(found)
                    own, sketch = signer.band_keys(least), np.concatenate([signer.sketch(least), parity(found)])
                high.append(a)
                low.append(b)
                keys.append(own)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(keys, longs), pa.array(sketches, longs)],
                names=["id", "n", "high", "low", "keys", "sketch"],
            )

    return run


def shared_shingles(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct sets."""
    both = np.concatenate([left, right])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(size: int, percent: int, repeated_ids: bool):
    def run(batches):
        last, last_set, shingles = None, None, Shingles(size)
        for batch in in_slices(batches, 7):
            fixed = [batch.column(c).to_pylist() for c in range(6)]
            lefts, linked = batch.column(6), []
            for i, right in enumerate(shingles.sets(batch.column(7))):
                u, v, u_high, u_low, v_high, v_low = (c[i] for c in fixed)
                if u != last or repeated_ids:
                    last, last_set = u, next(shingles.sets(lefts.slice(i, 1)))
                # an id that occurs with several texts meets all of them; only the fingerprinted ones count
                if repeated_ids and (
                    set_fingerprint(last_set) != (u_high, u_low) or set_fingerprint(right) != (v_high, v_low)
                ):
                    continue
                shared = shared_shingles(last_set, right)
                if 100 * shared >= percent * (len(last_set) + len(right) - shared):
                    linked.append(i)
            rows = batch.take(pa.array(linked, pa.int64()))
            yield rows.select(["u", "v", "u_popular", "v_popular"])

    return run


def _shingle_rows(size: int):
    def run(batches):
        shingles = Shingles(size)
        for batch in in_slices(batches, 3):
            node, high, low = (batch.column(c).to_pylist() for c in range(3))
            for i, found in enumerate(shingles.sets(batch.column(3))):
                # an id that occurs with several texts gives all of them; only the fingerprinted one counts
                if set_fingerprint(found) == (high[i], low[i]):
                    own = pa.array(np.full(len(found), node[i], np.int64))
                    yield pa.RecordBatch.from_arrays([own, pa.array(found.view(np.int64))], names=["node", "key"])

    return run


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """``key, node, size`` for band keys with two nodes or more."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def _members(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shared keys with ``n`` and ``sketch`` of the node and ``popular``, the number of nodes under all its keys.

    ``room`` is how many shingles a node can share with another one that it first meets under the key.
    """
    popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
    about = nodes.select("node", "n", "sketch", F.col("n").alias("room")).join(popular, "node")
    return shared.drop("size").join(about, "node")


def _may_lead(percent: int) -> Column:
    """Whether a node has room for a link with one that has as many shingles or more."""
    return (100 + percent) * F.col("room") >= 2 * percent * F.col("n")


def _open(members: DataFrame, percent: int) -> DataFrame:
    """Members of keys whose nodes do not all have one label, with the key's number of nodes as ``size``.

    A link has its smaller node among those that may lead, so keys without any of them have no link.
    """
    keys = members.groupBy("key").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size"), F.bool_or(_may_lead(percent)).alias("led")
    )
    return members.join(keys.where("a <> b AND led").select("key", "size"), "key")


def _by_rare_shingles(crowd: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Members of ``crowd`` (one row per node) under their rarest shingles; every link between two of its nodes is under one.

    Shingles have one order for all: by the number of nodes that hold them, then by value. If ``room`` shingles of a set are left
    from a place on, two sets whose first shared shingle is there share at most the lesser of their rooms. A link needs
    ``(100 + p) * shared >= p * (a + b)``, so a shingle with less room than ``p`` % of its set is never the first shared one.
    """
    own = texts.join(crowd.select("node"), "node", "left_semi").select("node", "high", "low", "text")
    rows = own.mapInArrow(_shingle_rows(size), "node long, key long")
    holders = F.count("*").over(Window.partitionBy("key"))
    # a shingle of one node only comes before all shared ones
    rows = rows.withColumn("holders", holders).where("holders > 1")
    places = Window.partitionBy("node").orderBy(F.desc("holders"), F.desc("key"))
    rows = rows.withColumn("room", F.row_number().over(places).cast("long")).drop("holders")
    return rows.join(crowd, "node").where(100 * F.col("room") >= percent * F.col("n"))


def _alike(words: int, coordinates: int, percent: int) -> Column:
    """False if the sketches of two nodes, or their rooms under the key, rule out a link."""
    # a coordinate that differs leaves a bit in the lower place of its pair
    lower = F.lit(sum(1 << (SKETCH_BITS * i) for i in range(64 // SKETCH_BITS))).cast("long")
    differ = [F.get("sketch", F.lit(i)).bitwiseXOR(F.get("u_sketch", F.lit(i))) for i in range(words + PARITY_BITS // 64)]
    coordinate = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(lower)) for x in differ[:words]), F.lit(0))
    bits = sum((F.bit_count(x) for x in differ[words:]), F.lit(0))
    # similarity p means (100 + p) * |A ^ B| <= (100 - p) * (|A| + |B|)
    total = F.col("n") + F.col("u_n")
    return (
        ((100 + percent) * F.least("room", "u_room") >= percent * total)
        & ((100 + percent) * bits <= (100 - percent) * total)
        & (coordinate <= coordinates - int(SKETCH_SHARE * coordinates))
    )


def _texts_of(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, bool]:
    """Texts of the nodes that have a candidate, and whether a node has more than one because its id repeats."""
    wanted = written(members.select("node").distinct().join(nodes, "node").select("node", "id", "high", "low"), "near-ids")
    side = wanted.withColumnRenamed("id", "_id")
    n = wanted.count()
    if n <= BROADCAST_IDS:
        side = F.broadcast(side)
    found = docs.join(side, F.col("id").eqNullSafe(F.col("_id"))).select("node", "high", "low", "text")
    found = written(found, "near-texts")
    return found, found.count() > n


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int, repeated_ids: bool) -> DataFrame:
    left = texts.select(F.col("node").alias("u"), F.col("high").alias("u_high"), F.col("low").alias("u_low"),
                        F.col("text").alias("u_text"))
    right = texts.select(F.col("node").alias("v"), F.col("high").alias("v_high"), F.col("low").alias("v_low"),
                         F.col("text").alias("v_text"))
    both = pairs.join(right, "v").join(left, "u")
    both = both.select("u", "v", "u_high", "u_low", "v_high", "v_low", "u_text", "v_text", "u_popular", "v_popular")
    return both.mapInArrow(_verify(size, percent, repeated_ids), "u long, v long, u_popular long, v_popular long")


def _labels(links: DataFrame) -> DataFrame:
    """``node, label``: of a node and the nodes it is linked to, the one that is most popular, of equals the smallest.

    Nodes with one label are connected; not all connected ones have one label.
    """
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("other"), F.col("v_popular").alias("popular"), F.col("u_popular").alias("own")),
        F.struct(F.col("v").alias("node"), F.col("u").alias("other"), F.col("u_popular").alias("popular"), F.col("v_popular").alias("own")),
    )
    ends = links.select(F.inline(ends))
    # a node is its own candidate
    ends = ends.select("node", F.inline(F.array(F.struct("popular", F.col("other").alias("label")), F.struct(F.col("own").alias("popular"), F.col("node").alias("label")))))
    best = ends.groupBy("node").agg(F.max(F.struct("popular", (-F.col("label")).alias("order"), "label")).alias("best"))
    return best.select("node", F.col("best.label").alias("label"))


def near_duplicate_links(
    docs: DataFrame, nodes: DataFrame, percent: int, size: int, bands: int, rows: int
) -> DataFrame | None:
    """Links ``u, v`` between nodes that connect every two nodes joined by a chain of candidate pairs of enough similarity."""
    shared = written(_shared_keys(nodes), "near-shared")
    if shared.isEmpty():
        return None
    texts, repeated_ids = _texts_of(docs, nodes, shared)
    alike = _alike(-(-bands * rows * SKETCH_BITS // 64), bands * rows, percent)
    links, pivots, crowd = None, FIRST_PIVOTS, None
    members, open_members = _members(shared, nodes).withColumn("label", F.col("node")), None
    while True:
        # the most popular nodes of a key that may lead are its pivots; all others, and later pivots, are compared with them
        order = Window.partitionBy("key").orderBy(F.desc(_may_lead(percent)), F.desc("popular"), "node")
        ranked = written(members.withColumn("place", F.row_number().over(order)), "near-ranked")
        discard(open_members, shared, crowd)
        top = ranked.where((F.col("place") <= pivots) & _may_lead(percent)).select(
            "key", F.col("node").alias("u"), F.col("label").alias("u_label"), F.col("n").alias("u_n"),
            F.col("sketch").alias("u_sketch"), F.col("popular").alias("u_popular"), F.col("place").alias("u_place"),
            F.col("room").alias("u_room"),
        )
        pairs = ranked.join(top, "key").where(
            (F.col("u_place") < F.col("place"))
            & (F.col("label") != F.col("u_label"))
            & alike
        )
        swap = F.col("node") < F.col("u")
        pairs = pairs.select(
            F.least("node", "u").alias("u"), F.greatest("node", "u").alias("v"),
            F.when(swap, F.col("popular")).otherwise(F.col("u_popular")).alias("u_popular"),
            F.when(swap, F.col("u_popular")).otherwise(F.col("popular")).alias("v_popular"),
        ).distinct()
        pairs = written(pairs, "near-pairs")
        found = written(_links(pairs, texts, size, percent, repeated_ids), "near-links")
        links = found if links is None else links.unionByName(found)
        left = ranked.where(F.col("place") > pivots).drop("label", "place").join(_labels(links), "node", "left")
        open_members = written(_open(left.withColumn("label", F.coalesce("label", "node")), percent), "near-members")
        discard(ranked, pairs)
        members = open_members
        if members.isEmpty():
            discard(texts, open_members)
            return links.select("u", "v")
        if crowd is None:
            large = F.col("size") > LARGE_KEY
            crowd = members.where(large).drop("key", "room", "size").dropDuplicates(["node"])
            crowd = written(crowd, "near-crowd")
            members = members.where(~large)
            if not crowd.isEmpty():
                rare = _open(_by_rare_shingles(crowd, texts, size, percent), percent)
                members = members.unionByName(rare)
        members = members.drop("size")
        pivots *= MORE_PIVOTS


def near_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = SIMILARITY_PERCENT,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: ``id_column``, ``n_shingles``, ``component_id``, ``kept``.

    Two texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word shingles; a component is
    what links reach; the row with the smallest id of a component is kept. A NULL, empty or blank text has no shingle, is linked
    with nothing and kept. Fewer than ``size`` words are one shingle. Rows that repeat an id with the same text are one
    document, of which one row is kept; a repeated id with other texts is compared text by text. NULL ids sort first.
    An empty table gives an empty result. Other columns are not read.
    """
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    profile = docs.mapInArrow(
        _profile(size, bands, rows), "id long, n long, high long, low long, keys array<long>, sketch array<long>"
    )
    profile = written(profile.withColumn("row", F.monotonically_increasing_id()), "near-profile")
    filled = profile.where("n > 0")
    sets = filled.groupBy("high", "low", "n").agg(F.min("row").alias("node"))
    heads = filled.select(F.col("row").alias("node"), "id", "high", "low", "n", "keys", "sketch")
    nodes = written(sets.select("node").join(heads, "node"), "near-nodes")
    links = near_duplicate_links(docs, nodes, percent, size, bands, rows)

    rows_of = filled.select("row", "id", "n", "high", "low").join(sets, ["high", "low", "n"])
    if links is None:
        rows_of = rows_of.withColumn("component", F.col("node"))
    else:
        found = written(connected_components(links), "near-components")
        rows_of = rows_of.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows_of = written(rows_of.select("row", "id", "n", "component"), "near-rows")
    # NULL sorts first, so it is written as the least number here
    key = F.coalesce("id", F.lit(-(2**63)))
    least = rows_of.groupBy("component").agg(F.min(key).alias("least"), F.min_by("row", key).alias("first"))
    rows_of = rows_of.join(least, "component").select(
        "id", "n", F.nullif("least", F.lit(-(2**63))).alias("component"), (F.col("row") == F.col("first")).alias("kept")
    )
    empty = profile.where("n = 0").select("id", "n", F.col("id").alias("component"), F.lit(True).alias("kept"))
    return rows_of.unionByName(empty).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept"
    )


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``df`` with one row of each group of near-duplicates; all columns stay. Rows that repeat an id keep one row of it."""
    found = near_duplicates(df, id_column, text_column, **settings).select(F.col(id_column).alias("id"), "kept")
    ids = written(found.groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "near-kept")
    if not ids.where("n > 1").isEmpty():
        df = df.dropDuplicates([id_column])
    return without_ids(df, id_column, ids.where("not kept").select("id"))
