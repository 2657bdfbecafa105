"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells, one row kept per group.

* Equal vectors of a label are one node with a count, so copies cost nothing further on.
* Each label with more than ``CELL_NODES`` nodes is divided by spherical k-means, fitted on a bounded sample. A vector lives in
  the cell of its nearest centroid and is a guest in every later cell in which a partner could live: a partner y of x has an
  angle of at most acos(threshold) to x, and if y prefers centroid c' to the centroid c of x, the plane halfway between both
  is no further from x than the sine of that angle. So no link is lost at a cell border.
* A cell is cut into blocks of ``BLOCK`` nodes and each pair of blocks is one small group, so a cell of any size is spread over
  all tasks. A pair of blocks gives link counts per node and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.components import connected_components
from gustline.llm.tables import written
from gustline.llm.vectors import SAMPLE_ROWS, fit_centroids, matrix, unit_rows, usable, usual_dimension

THRESHOLD = 0.93
CELL_NODES = 4096
BLOCK = 1024
# Centroids held by every task: 64 dimensions make this 10 MB. Labels that would need more get larger cells instead.
MAX_CENTROIDS = 20_000


def _fit(nodes: DataFrame, dimension: int) -> dict[int, np.ndarray]:
    """Centroids by label for labels with more than one cell's nodes."""
    large = nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > CELL_NODES)
    large = large.orderBy(F.desc("n")).limit(MAX_CENTROIDS // 2).collect()
    if not large:
        return {}
    wanted = {r["label"]: -(-r["n"] // CELL_NODES) for r in large}
    scale = min(1.0, MAX_CENTROIDS / sum(wanted.values()))
    wanted = {label: max(2, int(n * scale)) for label, n in wanted.items()}
    per_label = max(2, SAMPLE_ROWS // len(wanted))
    side = F.broadcast(nodes.sparkSession.createDataFrame([(label,) for label in wanted], nodes.select("label").schema))
    order = Window.partitionBy("label").orderBy(F.xxhash64("node"), "node")
    sample = nodes.join(side, "label").select("label", "vector", F.row_number().over(order).alias("place"))
    sample = sample.where(F.col("place") <= per_label).toPandas()
    return {
        label: fit_centroids(unit_rows(matrix(rows["vector"], dimension)), wanted[label], spherical=True)
        for label, rows in sample.groupby("label")
    }


def guests(rows: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and a mask of the later cells in which a partner could live."""
    near = rows @ centroids.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, ((centroids[home][:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)))
    lead = near[np.arange(len(rows)), home][:, None] - near
    reach = np.sqrt(max(0.0, 1.0 - threshold * threshold)) * apart + 1e-9
    later = np.arange(len(centroids))[None, :] > home[:, None]
    return home, later & (lead <= reach)


def _cells(centroids: dict[int, np.ndarray], dimension: int, threshold: float):
    def run(batches):
        for batch in batches:
            for label, rows in batch.groupby("label"):
                own = centroids.get(label)
                if own is None:
                    yield rows.assign(cell=0, home=True)
                    continue
                # a row meets all centroids of its label at once, so rows are taken in slices
                step = max(1, 2_000_000 // (len(own) * dimension))
                for at in range(0, len(rows), step):
                    part = rows.iloc[at : at + step]
                    home, visits = guests(unit_rows(matrix(part["vector"], dimension)), own, threshold)
                    yield part.assign(cell=home, home=True)
                    who, where = np.nonzero(visits)
                    if len(who):
                        yield part.iloc[who].assign(cell=where, home=False)

    return run


def _forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``mask`` connects, at most one per row and column."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask, left, right = mask[np.ix_(rows, columns)], left[rows], right[columns]
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        old = a.copy(), b.copy()
        a = np.minimum(a, np.where(mask, b[None, :], top).min(axis=1))
        b = np.minimum(b, np.where(mask, a[:, None], top).min(axis=0))
        if (a == old[0]).all() and (b == old[1]).all():
            break
    return np.concatenate([left, right]), np.concatenate([a, b])


def _compare(dimension: int, threshold: float):
    def run(key, rows):
        first, second = key[3], key[4]
        left = rows[(rows["block"] == first) & (rows["side"] == 0)]
        right = rows[(rows["block"] == second) & (rows["side"] == 1)]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        same = key[2] and first == second
        cosines = unit_rows(matrix(left["vector"], dimension)) @ unit_rows(matrix(right["vector"], dimension)).T
        mask = cosines >= threshold
        u, v = left["node"].to_numpy(), right["node"].to_numpy()
        if same:
            mask &= u[:, None] != v[None, :]
        if not mask.any():
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        u_links = mask @ right["n"].to_numpy().astype(np.float64)
        counts = [(u, u_links)] if same else [(u, u_links), (v, left["n"].to_numpy().astype(np.float64) @ mask)]
        out = [pd.DataFrame({"u": n, "v": n, "links": c.astype(np.int64)})[c > 0] for n, c in counts]
        a, b = _forest(mask, u, v)
        out.append(pd.DataFrame({"u": a, "v": b, "links": 0})[a != b])
        return pd.concat(out).astype("int64")

    return run


def _links(nodes: DataFrame, dimension: int, threshold: float) -> DataFrame:
    """``u, v, links``: links of nodes (u = v) and links that connect the components (links = 0)."""
    centroids = _fit(nodes, dimension)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    cells = written(
        nodes.mapInPandas(_cells(centroids, dimension, threshold), f"{fields}, cell int, home boolean"), "embed-cells"
    )
    counts = cells.groupBy("label", "cell").agg(
        F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("guests")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = counts.select("label", "cell", blocks(F.col("homes")).alias("h"), blocks(F.col("guests")).alias("g"))
    rows = cells.join(counts, ["label", "cell"])
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int")
    rows = rows.withColumn("block", spread)
    # home blocks meet home blocks with the same or a higher number, guest blocks meet every home block
    pair = lambda homes, first, second, side: F.struct(
        F.lit(homes).alias("homes"), first.alias("first"), second.alias("second"), F.lit(side).alias("side")
    )
    own, others = F.col("block"), F.sequence(F.lit(0), F.col("h") - 1)
    as_left = F.transform(F.filter(others, lambda j: j >= own), lambda j: pair(True, own, j, 0))
    as_right = F.transform(F.filter(others, lambda i: i <= own), lambda i: pair(True, i, own, 1))
    guest_blocks = F.when(F.col("g") > 0, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array().cast("array<int>"))
    as_host = F.transform(guest_blocks, lambda i: pair(False, i, own, 1))
    as_guest = F.transform(others, lambda j: pair(False, own, j, 0))
    meets = F.when(F.col("home"), F.concat(as_left, as_right, as_host)).otherwise(
        F.when(F.col("h") > 0, as_guest).otherwise(F.array().cast(meets_type()))
    )
    rows = rows.select("label", "cell", "node", "n", "vector", "block", F.explode(meets).alias("m"))
    rows = rows.select("label", "cell", "node", "n", "vector", "block", "m.*")
    return rows.groupBy("label", "cell", "homes", "first", "second").applyInPandas(
        _compare(dimension, threshold), "u long, v long, links long"
    )


def meets_type() -> str:
    return "array<struct<homes:boolean,first:int,second:int,side:int>>"


def near_embeddings(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str | None = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: ``id_column, n_links, component_id, kept``.

    Rows of the same label are linked if the cosine of their vectors is at least ``threshold``, in double precision. A row whose
    label is NULL or whose vector is NULL, zero, of another length than most, or holds NULL or non-finite components is linked
    with nothing and kept. Without a label column all rows are compared. Repeated rows are linked with each other; rows that
    repeat the smallest id of a group are all kept. An empty table gives an empty result. Other columns are not read.
    """
    label = F.col(f"`{label_column}`") if label_column else F.lit(0)
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_column}`").alias("vector"))
    filled = rows.where(usable(F.col("vector")) & F.col("label").isNotNull())
    dimension = usual_dimension(filled, "vector")
    fits = F.coalesce(usable(F.col("vector")) & F.col("label").isNotNull() & (F.size("vector") == dimension), F.lit(False))
    # NULL ids sort first
    key = F.coalesce("id", F.lit(-(2**63)))
    classes = rows.where(fits).groupBy("label", "vector").agg(F.min(key).alias("head"), F.count("*").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "embed-nodes")
    found = written(_links(classes.select("node", "n", "label", "vector"), dimension, threshold), "embed-links")
    links = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("u <> v").select("u", "v"))
    heads = classes.select("node", "label", "vector", "head", "n").join(component, "node", "left").join(links, "node", "left")
    heads = heads.withColumn("component", F.coalesce("component", "node"))
    least = heads.groupBy("component").agg(F.min("head").alias("least"))
    heads = heads.join(least, "component").select(
        "label", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    linked = rows.where(fits).join(heads, ["label", "vector"]).select(
        "id", "n_links", F.nullif("least", F.lit(-(2**63))).alias("component")
    )
    alone = rows.where(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
