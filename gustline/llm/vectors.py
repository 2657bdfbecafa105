"""Vector columns: which ones take part, as matrices, and k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows brought to the driver to fit centroids on, whatever the size of the table.
SAMPLE_ROWS = 20_000
ROUNDS = 8


def usable(vector: Column) -> Column:
    """True for a vector without NULL and non-finite components that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length; of equally frequent ones the smallest. 0 for an empty table."""
    found = df.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return found["d"] if found else 0


def matrix(column: pd.Series, dimension: int) -> np.ndarray:
    """Rows of a list column in double precision."""
    if not len(column):
        return np.zeros((0, dimension))
    return np.stack(column.to_numpy()).astype(np.float64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    # a first division by the largest component keeps very large and very small vectors in range
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return (rows @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)).argmax(axis=1)


def fit_centroids(rows: np.ndarray, k: int, spherical: bool, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from randomly chosen rows; spherical ones keep centroids at length 1."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centroids = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=k)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        if spherical:
            lengths = np.sqrt((centroids * centroids).sum(axis=1, keepdims=True))
            centroids = np.where(lengths > 1e-9, centroids / np.maximum(lengths, 1e-9), centroids)
    return centroids
