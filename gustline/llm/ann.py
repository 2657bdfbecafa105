"""Approximate nearest neighbours by inverted lists and an adaptive dimension scan.

* Largest inner product becomes smallest distance: each row gets one more component, sqrt(M**2 - |x|**2) for the largest
  length M, a query gets 0 there.
* k-means centroids and a reference set are fitted on a bounded sample; every row is indexed in the list of its nearest centroid.
* A query probes the lists of its nearest centroids. The k nearest rows of the reference set (rows of the table) are its first
  results, and the distance to the last of them bounds what can still be one.
* In a list, rows and queries are rotated by a random orthogonal matrix and compared column block by column block: after d of D
  columns the partial distance times D/d estimates the whole one, and a candidate is abandoned as soon as it exceeds the bound
  by more than the error the estimate has with so many columns. The bound of a query falls while its list is scanned.
* What is left is scored exactly on the original vectors, and the best ones of all lists are ranked.

Lists and queries are cut into blocks, so a list that holds a third of all rows is many small groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.tables import written
from gustline.llm.vectors import SAMPLE_ROWS, fit_centroids, matrix, nearest, usable, usual_dimension

K = 20
# Share of the lists that a query probes. Vectors without clusters need this many; measured recall is in the README.
PROBE_SHARE = 0.75
# A small table has half as many lists as the root of its rows; a large one as few as hold a block of rows each, because every list and every
# block that a query meets is a copy of the query.
FEW_LISTS, MAX_LISTS = 32, 4096
# Rows of the sample that bound the distances, scanned once per query.
REFERENCE_ROWS = 4096
LIST_BLOCK, QUERY_BLOCK = 16_384, 4096
# Columns per step of the scan, rows taken before bounds are renewed, and the width of the test in standard errors.
COLUMN_BLOCK, SCAN_ROWS, WIDTH = 16, 512, 2.1
# Above this share of living pairs a column block is computed for all pairs of a step at once.
DENSE_SHARE = 0.02


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix that depends on the seed only."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def lengthened(rows: np.ndarray, largest: float | None) -> np.ndarray:
    """Rows with the component that makes all of them as long as the largest; queries (None) get 0."""
    if largest is None:
        extra = np.zeros(len(rows))
    else:
        extra = np.sqrt(np.maximum(0.0, largest * largest - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, extra])


def _block_norms(rows: np.ndarray) -> np.ndarray:
    """Squared length of each row within each column block."""
    starts = np.arange(0, rows.shape[1], COLUMN_BLOCK)
    return np.add.reduceat(rows * rows, starts, axis=1) if len(rows) else np.zeros((0, len(starts)))


def _test(bounds: np.ndarray, done: int, size: int) -> np.ndarray:
    """Partial distances over the first ``done`` columns beyond which a pair is given up: its whole distance is then above the bound but for
    a chance set by WIDTH. With all columns seen the bound itself decides."""
    return bounds * (done / size) * (1 + WIDTH / math.sqrt(done)) ** 2 if done < size else bounds


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the k nearest of a query, all columns rotated already.

    ``bounds``: squared distances beyond which nothing counts. ``own``: index of the row that is the query itself, or -1.
    """
    size = queries.shape[1]
    bounds = bounds.copy()
    best = np.full((len(queries), k), np.inf)
    kept_q, kept_x, kept_d = [], [], []
    norms = _block_norms(queries), _block_norms(rows)
    for at in range(0, len(rows), SCAN_ROWS):
        part = rows[at : at + SCAN_ROWS]
        partial, alive, done = np.zeros((len(queries), len(part))), None, 0
        # while many pairs live, a column block is one product for all of them
        while done < size and (alive is None or alive.mean() > DENSE_SHARE):
            high = min(size, done + COLUMN_BLOCK)
            block = done // COLUMN_BLOCK
            partial -= 2.0 * (queries[:, done:high] @ part[:, done:high].T)
            partial += norms[0][:, block, None] + norms[1][at : at + SCAN_ROWS, block]
            done = high
            alive = partial <= (_test(bounds, done, size) + 1e-9)[:, None]
        qi, xi = np.nonzero(alive)
        distance = partial[qi, xi]
        # the few that are left go on one by one
        while done < size and len(qi):
            high = min(size, done + COLUMN_BLOCK)
            difference = queries[qi, done:high] - part[xi, done:high]
            distance = distance + (difference * difference).sum(axis=1)
            done = high
            keep = distance <= _test(bounds, done, size)[qi] + 1e-9
            qi, xi, distance = qi[keep], xi[keep], distance[keep]
        keep = xi + at != own[qi]
        qi, xi, distance = qi[keep], xi[keep] + at, distance[keep]
        kept_q.append(qi)
        kept_x.append(xi)
        kept_d.append(distance)
        # pairs are in the order of their queries
        edges = np.searchsorted(qi, np.arange(len(queries) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            near = distance[edges[i] : edges[i + 1]]
            merged = np.concatenate([best[i], near])
            best[i] = np.partition(merged, k - 1)[:k]
            bounds[i] = min(bounds[i], best[i].max())
    qi, xi, distance = np.concatenate(kept_q), np.concatenate(kept_x), np.concatenate(kept_d)
    # bounds have fallen since; a little room is left so that equal ones are judged by exact scores
    keep = distance <= bounds[qi] + 1e-7 * (1 + np.abs(bounds[qi]))
    return qi[keep], xi[keep]


def _index(centroids: np.ndarray, largest: float, dimension: int):
    def run(batches):
        for batch in batches:
            rows = lengthened(matrix(batch["vector"], dimension), largest)
            yield batch.assign(list=nearest(rows, centroids))

    return run


def _probe(centroids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, largest: float, probes: int, k: int):
    """Lists to probe, the bound, and the nearest rows of the reference set with their scores, for each query."""

    def run(batches):
        reference = lengthened(sample, largest)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                plain = matrix(part["vector"], sample.shape[1])
                rows = lengthened(plain, None)
                lists = np.argsort(0.5 * (centroids * centroids).sum(axis=1) - rows @ centroids.T, axis=1, kind="stable")
                distance = (rows * rows).sum(axis=1)[:, None] + (reference * reference).sum(axis=1)[None, :] - 2 * rows @ reference.T
                distance[part["id"].to_numpy()[:, None] == sample_ids[None, :]] = np.inf
                first = np.argsort(distance, axis=1, kind="stable")[:, :k]
                reached = np.take_along_axis(distance, first, axis=1)
                found = [np.flatnonzero(np.isfinite(r)) for r in reached]
                yield part.assign(
                    bound=[r[k - 1] + 1e-9 if len(r) >= k else np.inf for r in reached],
                    lists=[x[:probes].astype(np.int32) for x in lists],
                    first=[sample_ids[f[o]] for f, o in zip(first, found, strict=True)],
                    scores=[(plain[i] * sample[f[o]]).sum(axis=1) for i, (f, o) in enumerate(zip(first, found, strict=True))],
                )

    return run


def _scan(turn: np.ndarray, largest: float, dimension: int, k: int):
    def run(rows, queries):
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, q = matrix(rows["vector"], dimension), matrix(queries["vector"], dimension)
        ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
        at = {v: i for i, v in enumerate(ids.tolist())}
        own = np.array([at.get(v, -1) for v in query_ids.tolist()])
        qi, xi = adaptive_scan(lengthened(q, None) @ turn, lengthened(x, largest) @ turn, queries["bound"].to_numpy(), k, own)
        score = (q[qi] * x[xi]).sum(axis=1)
        order = np.lexsort([ids[xi], -score, qi])
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.searchsorted(qi, qi)  # index of the query's first pair
        keep = (np.arange(len(qi)) - first < k) & (ids[xi] != query_ids[qi])
        return pd.DataFrame({"query_id": query_ids[qi[keep]], "vec_id": ids[xi[keep]], "score": score[keep]})

    return run


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    probe_share: float = PROBE_SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``df`` with the largest inner product that
    were found, the query's own id left out, nearest first, ties to the smaller id.

    Rows and queries whose id is NULL, or whose vector is NULL, zero, of another length than most, or holds NULL or non-finite
    components take no part. Fewer than ``k`` candidates give fewer rows. Rows that repeat an id are found once, with the best score. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    ready = lambda t: t.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("vector")
    ).where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = ready(df)
    dimension = usual_dimension(rows, "vector")
    rows = rows.where(F.size("vector") == dimension)
    asked = ready(queries).where(F.size("vector") == dimension)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest = rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    plain, sample_ids = matrix(sample["vector"], dimension), sample["id"].to_numpy()
    fitted = lengthened(plain, largest)
    lists = max(1, min(FEW_LISTS, round(math.sqrt(n) / 2)), min(MAX_LISTS, math.ceil(n / LIST_BLOCK)))
    centroids = fit_centroids(fitted, lists, spherical=False)
    lists = len(centroids)
    probes = max(1, math.ceil(probe_share * lists))

    index = rows.mapInPandas(_index(centroids, largest, dimension), f"{_fields(rows)}, list int")
    index = written(index, "ann-index")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # a list of many rows is cut into blocks by a hash, queries likewise
    blocks = F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // LIST_BLOCK))) for i in range(lists)])
    n_queries = asked.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    probe = _probe(centroids, plain[:REFERENCE_ROWS], sample_ids[:REFERENCE_ROWS], largest, probes, k)
    extra = "bound double, lists array<int>, first array<long>, scores array<double>"
    asked = written(asked.mapInPandas(probe, f"{_fields(asked)}, {extra}"), "ann-queries")
    first = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("first", "scores")).alias("f"))
    first = first.select("query_id", F.col("f.first").alias("vec_id"), F.col("f.scores").alias("score"))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    asked = asked.select("id", "vector", "bound", "query_block", F.explode("lists").alias("list"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)))
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("list"))).cast("int"))
    index = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    key = ["list", "block", "query_block"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
        _scan(rotation(dimension + 1), largest, dimension, k), "query_id long, vec_id long, score double"
    )
    # a row of the reference set is met again in its list; one shuffle serves both steps
    found = found.unionByName(first).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
