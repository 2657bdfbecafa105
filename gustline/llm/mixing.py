"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Word counts per source give exact word targets: weights share the mix, a source stops at ``max_repeats`` times its size and
   the excess goes to the others by weight.
2. Each source's documents are put in the order of a keyed hash. A source gives whole passes over its documents and, for the
   rest of its target, the documents at the head of that order; documents behind the first one that does not fit fill the gap
   that is left, as many as it takes.
3. The order is cut into blocks. The block quotas of all sources are the root of a binary tree over the output shards: each
   node deals its left half a number of blocks by one multivariate-hypergeometric draw, the right half gets the others. A
   leaf walks down from the root by itself, since the draw of a node depends on the seed and the node only; so shards get
   exact, disjoint block ranges without talking to each other.
4. Blocks are permuted inside their source, dealt by these ranges, and the documents of a shard are shuffled inside it.

Ranks come from hash buckets: one small window per bucket and a prefix sum of bucket totals, so a source of any share is spread
over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.llm.tables import BROADCAST_IDS, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEATS = 1.5, 2.0
BLOCK_DOCUMENTS = 64
BLOCKS_PER_SHARD = 256
BUCKET_DOCUMENTS = 5_000
# Sources are a dimension: their totals (some 100 bytes each) are held on the driver. Tables with a row per source are broadcast up to this many.
BROADCAST_SOURCES = 100_000
# A prime above any number of blocks of a source that fits the tree (10**9), so multiplying by it permutes the blocks.
_STRIDE = 2_654_435_761


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[int], weights: list[float], share: float, max_repeats: float) -> list[float]:
    """Words per source: by weight, at most ``max_repeats`` times the size, the excess reshared until none is above.

    >>> source_targets([100, 100], [9, 1], 1.0, 1.5)
    [150.0, 50.0]
    """
    caps = [max_repeats * s for s in sizes]
    targets = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = caps[i]
            left -= caps[i]
        left = max(left, 0.0)
        free = [i for i in free if i not in set(over)]
    return targets


def leaf_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each source for one shard: a walk down the splitting tree."""
    low, high = 0, shards
    here, first = quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        draws = int(here.sum()) * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.Philox(key=seed, counter=[low, high, 0, 0]))
        left = rng.multivariate_hypergeometric(here, draws) if draws else np.zeros_like(here)
        if shard < middle:
            here, high = left, middle
        else:
            here, first, low = here - left, first + left, middle
    return first, here


def _per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row per source, ready to be joined with large ones."""
    side = spark.createDataFrame(rows, schema)
    return F.broadcast(side) if len(rows) <= BROADCAST_SOURCES else side


def _walk(quotas, shards: int, seed: int):
    """Blocks of each source for the shards of a task; ``quotas`` is a broadcast array."""

    def run(batches):
        own = quotas.value
        for batch in batches:
            for shard in batch["id"]:
                first, count = leaf_quotas(own, shards, int(shard), seed)
                at = np.flatnonzero(count)
                yield pd.DataFrame({"shard": int(shard), "s": at, "first": first[at], "count": count[at]})

    return run


def _ranked(rows: DataFrame, documents: int) -> DataFrame:
    """Add ``idx`` (place in the source's hash order, from 0) and ``cum`` (words up to and including the row)."""
    bits = max(0, math.ceil(math.log2(max(1, documents / BUCKET_DOCUMENTS))))
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    totals = totals.select("s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "row")
    rows = rows.withColumn("cum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("idx", F.row_number().over(inside) - 1).join(totals, ["s", "bucket"])
    return rows.withColumn("cum", F.col("cum") + F.col("words_before")).withColumn("idx", F.col("idx") + F.col("n_before")).drop(
        "bucket", "words_before", "n_before"
    )


def _fill(rows: DataFrame, gaps: dict[int, float], documents: int) -> DataFrame:
    """Rows outside the head that bring each source close to its target: ``s, row, h, size``.

    In each round a source takes the largest document that fits if that fills half of its gap, else the documents at the head of
    the hash order of all that fit. Both leave less than half of the gap or nothing that fits, so rounds end by themselves. Last,
    if one document too many at some round comes closer than all rounds, the source stops there with it.
    """
    spark = rows.sparkSession
    rows = rows.where("size > 0").select("s", "row", "h", "size")
    left, picked, number = rows, None, 0
    gaps = {s: g for s, g in gaps.items() if g > 0.5}
    # per source the least excess of one document too many: excess, round, size of the document
    over: dict[int, tuple[float, int, int]] = {}
    misses: dict[int, float] = {}
    while gaps:
        side = _per_source(spark, list(gaps.items()), "s long, gap double")
        fits = F.col("size") <= F.col("gap")
        near = left.join(side, "s").groupBy("s").agg(
            F.max(F.when(fits, F.col("size"))).alias("largest"), F.min(F.when(~fits, F.col("size"))).alias("next")
        )
        near = {r["s"]: r for r in near.collect()}
        limits = []
        for s, gap in gaps.items():
            largest, following = (near[s]["largest"], near[s]["next"]) if s in near else (None, None)
            if following is not None and following - gap < over.get(s, (gap,))[0]:
                over[s] = (following - gap, number, following)
            if largest is not None:
                single = 2 * largest >= gap
                limits.append((s, largest if single else 1, float(largest if single else gap)))
        misses |= gaps
        if not limits:
            break
        # of equally large ones the first in hash order
        side = _per_source(spark, limits, "s long, least long, most double")
        some = left.join(side, "s").where("size BETWEEN least AND most").drop("least")
        some = _ranked(some, documents).where("cum <= most").select("s", "row", "h", "size", F.lit(number).alias("round"))
        some = written(some, "mix-fill")
        words = {r["s"]: r["words"] for r in some.groupBy("s").agg(F.sum("size").alias("words")).collect()}
        misses |= {s: gaps[s] - w for s, w in words.items()}
        gaps = {s: misses[s] for s in words if misses[s] > 0.5}
        picked = some if picked is None else picked.unionByName(some)
        left = written(left.join(some.select("row"), "row", "left_anti"), "mix-left")
        number += 1
    over = {s: o for s, o in over.items() if o[0] < misses[s]}
    if picked is None:
        picked = rows.where("false").withColumn("round", F.lit(0))
    if over:
        stops = _per_source(spark, [(s, n, size) for s, (_, n, size) in over.items()], "s long, stop int, last long")
        picked = picked.join(stops, "s", "left").where("stop IS NULL OR round < stop").drop("stop", "last")
        last = rows.join(stops, "s").where("size = last").join(picked.select("row"), "row", "left_anti")
        last = last.groupBy("s").agg(F.min(F.struct("h", "row", "size")).alias("first")).select("s", "first.*")
        picked = picked.drop("round").unionByName(last.select("s", "row", "h", "size"))
    return picked.select("s", "row", "h", "size")


def plan_mix(
    sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``draws`` for a table of ``row`` (unique), ``id``, ``source``, ``size``; ``sized`` must be fixed (written).

    ``rows``: row, id, size, source_size, target. ``draws``: one row per time a document is taken: row, size, copy, shard,
    position (from 1 in its shard).
    """
    spark = sized.sparkSession
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = per_source.collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares code points
    sizes = [r["words"] for r in found]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, max_repeats)
    passes = [int(t // w) if w else 0 for t, w in zip(targets, sizes, strict=True)]
    rests = [t - p * w for t, p, w in zip(targets, passes, sizes, strict=True)]
    numbered = [
        (i, r["source"], r["words"], targets[i], passes[i], rests[i], r["n"], -(-r["n"] // BLOCK_DOCUMENTS))
        for i, r in enumerate(found)
    ]
    side = _per_source(
        spark, numbered, "s long, _source string, source_size long, target double, passes int, rest double, n long, pass_blocks long"
    )
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "size"))
    rows = written(_ranked(rows, sum(r["n"] for r in found)), "mix-rows")

    head = (F.col("rest") > 0) & (F.col("cum") <= F.col("rest"))
    heads = rows.where(head).groupBy("s").agg(F.count("*").alias("n"), F.max("cum").alias("words")).collect()
    head_n = {r["s"]: r["n"] for r in heads}
    gaps = {i: rests[i] for i in range(len(found))} | {r["s"]: rests[r["s"]] - r["words"] for r in heads}
    documents = sum(r["n"] for r in found)
    # fillers follow the head: places in the order from the head's end
    extra = _ranked(_fill(rows.where(~head), gaps, documents), documents)
    heads = _per_source(spark, [(i, head_n.get(i, 0)) for i in range(len(found))], "s long, head_n long")
    extra = extra.join(heads, "s").select("row", (F.col("idx") + F.col("head_n")).alias("filler"), F.col("s").alias("_s"))
    extra = written(extra, "mix-fillers")
    fillers = {r["_s"]: r["count"] for r in extra.groupBy("_s").count().collect()}
    extra = extra.drop("_s")
    if sum(fillers.values()) <= BROADCAST_IDS:
        extra = F.broadcast(extra)
    rest_blocks = [-(-(head_n.get(i, 0) + fillers.get(i, 0)) // BLOCK_DOCUMENTS) for i in range(len(found))]
    quotas = [passes[i] * numbered[i][7] + rest_blocks[i] for i in range(len(found))]

    drawn = rows.join(extra, "row", "left")
    taken = F.col("passes") + (head | F.col("filler").isNotNull()).cast("int")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), taken))).where(taken > 0)
    place = F.when(F.col("copy") > F.col("passes"), F.coalesce("filler", "idx")).otherwise(F.col("idx"))
    block = F.floor(place / BLOCK_DOCUMENTS) + (F.col("copy") - 1) * F.col("pass_blocks")
    drawn = drawn.join(_per_source(spark, list(enumerate(quotas)), "s long, quota long"), "s")
    drawn = drawn.withColumn("block", (block * _STRIDE + seed) % F.col("quota"))

    shards = max(1, -(-sum(quotas) // BLOCKS_PER_SHARD))
    dealt = spark.range(shards).mapInPandas(_walk(spark.sparkContext.broadcast(np.array(quotas, np.int64)), shards, seed), "shard long, s long, first long, count long")
    dealt = dealt.select(
        "shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("block")
    )
    drawn = drawn.select("row", "h", "size", "copy", "s", "block").join(dealt, ["s", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h", "copy"), "row", "copy")
    draws = drawn.select("row", "size", "copy", "shard", F.row_number().over(local).alias("position"))
    return rows.select("row", "id", "size", "source_size", "target"), draws


def mix_report(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings
) -> DataFrame:
    """Per input row: ``id_column``, ``size`` (words), ``source_size``, ``target`` of its source, ``taken`` (words, repeats counted).

    A NULL or blank text has size 0. NULL is a source of its own and sorts last. Rows that repeat an id are rows of their own;
    their order in the mix then follows the row order of the table. An empty table gives an empty result; a table without any
    word has targets of 0. Other columns are not read.
    """
    sized = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
    )
    rows, draws = plan_mix(written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes"), **settings)
    taken = draws.groupBy("row").agg(F.sum("size").alias("taken"))
    return rows.join(taken, "row", "left").select(
        F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **settings
) -> DataFrame:
    """The mix itself: ``df``'s columns, one row per time a document is taken, shard by shard in shuffled order.

    A partition holds whole shards. Odd cases as in :func:`mix_report`.
    """
    fixed = written(df.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-input")
    sized = fixed.select(
        F.col("_mix_row").alias("row"), F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{source_column}`").cast("string").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"),
    )
    _, draws = plan_mix(written(sized, "mix-sizes"), **settings)
    draws = draws.select(F.col("row").alias("_mix_row"), F.col("shard").alias("_mix_shard"), F.col("position").alias("_mix_place"))
    draws = written(draws, "mix-draws")
    shards = (draws.agg(F.max("_mix_shard")).first()[0] or 0) + 1
    side = F.broadcast(draws) if draws.count() <= BROADCAST_IDS else draws
    rows = fixed.join(side, "_mix_row").repartition(shards, "_mix_shard").sortWithinPartitions("_mix_shard", "_mix_place")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
