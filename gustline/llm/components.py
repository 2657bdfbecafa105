"""Connected components of a table of links, by alternating star contraction.

Each round rewires the links towards smaller ids with two grouped minima and two joins; the number of rounds grows with the
logarithm of the longest path. Links stay in Spark: only whether a round is the last reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.tables import discard, written


def _towards_least(links: DataFrame, both: bool) -> DataFrame:
    """Link each node's larger (``both``) or smaller neighbours, and itself, to the least of them."""
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if both:
        joined = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        joined = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return joined.where("u <> v").distinct()


def _star_pass(links: DataFrame) -> DataFrame:
    """One round on ``links(u, v)`` with ``u > v``: other links with the same components, closer to their smallest ids."""
    return _towards_least(_towards_least(links, both=True), both=False)


def _finished(links: DataFrame) -> bool:
    """True if every node is linked to one smaller node, and that to none."""
    parents = links.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    if not parents.where("n > 1").isEmpty():
        return False
    above = links.select(F.col("u").alias("v")).distinct()
    return links.join(above, "v", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; ``component`` is the smallest node reachable.

    Links go both ways, may repeat and may join a node with itself. NULL ids are left out. An empty table gives an empty one.
    """
    links = links.where("u is not null and v is not null and u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, "links")
    while not _finished(links):
        closer = written(_star_pass(links), "links")
        discard(links)
        links = closer
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
