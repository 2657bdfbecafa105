import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gustline.llm import near_dedup
from gustline.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_force(rows):
    """``(id, n_shingles, component, kept)`` for rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def found(df):
    return sorted(tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(6, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            other = list(base)
            for _ in range(rng.randrange(0, 1 + len(other) // 25)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\t".join(other).upper())
    # a passage that many texts share, and a third of the rows as copies
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(20, 60))) for _ in range(40)]
    texts += [texts[0]] * (len(texts) // 2)
    texts += [None, "", " \n\t", "one two", "ONE\x0bTwo", "one two three", "ünï çødé", "Ünï çødé", "a" * 70000, "b " * 3000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in rows]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute_force(rows)


def test_refined_and_repeated_rounds_equal_brute_force(spark, monkeypatch):
    """Every key is refined and every round has one pivot more than the last."""
    monkeypatch.setattr(near_dedup, "LARGE_KEY", 3)
    monkeypatch.setattr(near_dedup, "MORE_PIVOTS", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rows = corpus()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_repeated_null_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "another text of six words here"), (None, text), (5, text), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("keys", F.lit(1))
    got = near_dedup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    assert rows == sorted(
        [(None, 26, None, True), (1, 26, None, False), (1, 26, None, False), (1, 2, 1, True), (5, 26, None, False), (7, 0, 7, True), (7, 0, 7, True)],
        key=str,
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).collect() == []
    assert near_dedup.drop_near_duplicates(df).collect() == []


def test_drop_keeps_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (3, None, "c")], "doc_id long, text string, kept string")
    assert sorted(tuple(r) for r in near_dedup.drop_near_duplicates(df).collect()) == [(1, text, "b"), (3, None, "c")]


def test_sketches_never_rule_out_a_link():
    import numpy as np

    from gustline.llm.words import Shingles

    rng, shingles, signer = random.Random(3), Shingles(5), near_dedup.Signer(32, 4)
    import pyarrow as pa

    for _ in range(200):
        base = [rng.randrange(10**6) for _ in range(rng.randrange(20, 300))]
        other = list(base)
        for _ in range(max(1, len(other) // 40)):
            other[rng.randrange(len(other))] = -1
        a, b = shingles.sets(pa.array([" ".join(map(str, base)), " ".join(map(str, other))]))
        shared = near_dedup.shared_shingles(a, b)
        assert shared == len(np.intersect1d(a, b))
        differ = sum(int(x).bit_count() for x in (near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64))
        assert differ <= len(a) + len(b) - 2 * shared
        assert len(signer.band_keys(signer.signature(a))) == 32


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(50)], [(9, i) for i in range(30)], [(5, 3), (3, 5), (8, 9), (9, 1), (1, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert sorted(tuple(r) for r in connected_components(df).collect()) == sorted((i, root(i)) for i in parent)


def test_lone_pairs_of_a_template_family_are_linked(spark):
    """3,000 texts around one passage are not linked with each other (0.724), but 600 pairs of them are (86 of 114 shingles)."""
    passage = " ".join(f"p{i}" for i in range(88))
    rows = []
    for i in range(3000):
        pair = i % 1500 if i % 1500 < 600 else i
        tail = [f"t{pair}", f"u{pair}", *(f"x{i}y{k}" for k in range(14))]
        rows.append((i, passage + " " + " ".join(tail)))
    want = [(i, 100, i - 1500 if 1500 <= i < 2100 else i, not 1500 <= i < 2100) for i in range(3000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
