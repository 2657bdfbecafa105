import math

import numpy as np
import pytest

from gustline.llm import ann, embed_dedup
from gustline.llm.vectors import fit_centroids


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clusters(n, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.7 * rng.standard_normal((n, d))).astype(np.float32)
    return x * rng.uniform(0.5, 2.0, (n, 1)).astype(np.float32)


def brute_force(x, ids, queries, k):
    x = x.astype(np.float64)
    out = {}
    for q in queries:
        scores = (x * x[q]).sum(axis=1)
        order = np.lexsort([ids, -scores])
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_recall_and_exact_scores(spark, monkeypatch, small):
    """Also with lists and queries cut into small blocks, and a reference set that is no help."""
    if small:
        monkeypatch.setattr(ann, "LIST_BLOCK", 20)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
        monkeypatch.setattr(ann, "SCAN_ROWS", 16)
        monkeypatch.setattr(ann, "REFERENCE_ROWS", 30)
    x = clusters(900)
    ids = np.arange(900) * 7
    df = table(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)])
    queries = df.where("vec_id % 20 = 0")
    found = ann.nearest_neighbours(df, queries, k=20).collect()
    want = brute_force(x, ids, np.flatnonzero(ids % 20 == 0), 20)
    by_query = {q: sorted((r for r in found if r.query_id == q), key=lambda r: r.rank) for q in want}
    hits = 0
    for q, best in want.items():
        rows = by_query[q]
        assert [r.rank for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        exact = dict(brute_force(x, ids, [q // 7], 900)[q])
        assert all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in rows)
        hits += len({r.vec_id for r in rows} & {i for i, _ in best})
    assert hits >= 0.95 * 20 * len(want)


def test_ties_copies_and_rows_without_a_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(0, 200)]
    rows += [(300, None, 0), (320, [0.0, 0.0, 0.0], 0), (340, [1.0, None, 1.0], 0), (360, [float("nan"), 1.0, 1.0], 0), (380, [1.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    df = table(spark, rows)
    found = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=5).collect()
    assert {r.query_id for r in found} == set(range(0, 200, 20))
    for q in range(0, 200, 20):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(6) if i != q][:5]
    assert all(math.isclose(r.score, 14.0) for r in found)


def test_few_rows_and_empty_table(spark):
    df = table(spark, [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [1.0, 1.0], 2)])
    found = {(r.query_id, r.rank): r.vec_id for r in ann.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()}
    assert found == {(0, 1): 3, (0, 2): 20, (20, 1): 3, (20, 2): 0}
    assert ann.nearest_neighbours(table(spark, []), table(spark, [])).collect() == []


def test_rotation_keeps_lengths():
    turn = ann.rotation(9)
    assert np.allclose(turn @ turn.T, np.eye(9))


def links_of(x, labels, threshold):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)


def near_vectors(n=600, d=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, d))
    x = base[rng.integers(0, len(base), n)] + rng.uniform(0, 0.35, (n, 1)) * rng.standard_normal((n, d))
    x[: n // 4] = x[0]
    return x.astype(np.float32), rng.integers(0, 3, n)


@pytest.mark.parametrize("cell,block", [(4096, 1024), (40, 1024), (40, 16), (4096, 50)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cell, block):
    """No link is lost at the border of a cell or a block."""
    monkeypatch.setattr(embed_dedup, "CELL_NODES", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    x, labels = near_vectors()
    ids = np.random.default_rng(0).permutation(len(x))
    df = table(spark, [(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, labels, strict=True)]).repartition(3)
    mask = links_of(x, labels, 0.93)
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(mask, component[None, :], len(x)).min(axis=1))
        if (new == component).all():
            break
        component = new
    want = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, mask.sum(axis=1), component, strict=True))
    got = embed_dedup.near_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == want


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("inf"), 1.0], 0),
            (7, [1.0, None], 0), (8, [1.0], 0), (9, [1e-30, 0.0], 0), (10, [-1.0, 0.0], 0), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_embeddings(table(spark, rows)).collect()}
    assert found == {(1, 2, 1, True), (2, 2, 1, False), (9, 2, 1, False), (11, 1, None, False), (None, 1, None, True),
                     *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))}
    assert embed_dedup.near_embeddings(table(spark, [])).collect() == []


def test_guest_rule_finds_every_partner():
    """Whoever is near a vector lives in its cell, or one of both is a guest of the other's."""
    x, _ = near_vectors(400, 12, 4)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    centroids = fit_centroids(unit, 15, spherical=True)
    home, visits = embed_dedup.guests(unit, centroids, 0.93)
    for a, b in zip(*np.nonzero(unit @ unit.T >= 0.93), strict=True):
        if home[a] < home[b]:
            assert visits[a, home[b]]
