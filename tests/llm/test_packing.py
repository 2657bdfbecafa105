import bisect
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gustline.llm import packing

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "hello world", "<|endoftext|> is one id", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "|>x<|", "tab\tand\n\nlines  ", "ünï çødé 日本語 🎉", "a" * 3000, "x y " * 5000,
    " \u0085 odd blanks \x00", "don't can't WE'LL 1234567 ½ Ⅷ", " ".join(str(i) for i in range(9000)),
]


def reference_ids(text):
    tokenizer = tokenizers.Tokenizer.from_file(VOCABULARY)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_fast_ids_equal_the_vocabulary_s_own():
    encode = packing.encoder(VOCABULARY)
    for text in TEXTS[1:]:
        assert [*encode(text), 0] == reference_ids(text)
    assert list(encode("a <|endoftext|> b")) == [64, 220, 50256, 275]
    long = "word " * 250_000
    assert list(encode(long)) == reference_ids(long)[:-1]


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_fast_ids_equal_on_any_text(text):
    assert [*packing.encoder(VOCABULARY)(text), 0] == reference_ids(text)


def check_places(rows, capacity=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else capacity) - length)
    return len(gaps)


def test_pieces_and_places(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.packing_report(df, VOCABULARY).collect()
    check_places(rows)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids, at = np.array(reference_ids(text), "<u4"), 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:]) and len(pieces) == -(-len(ids) // 2048)
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_sequences_hold_the_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])] * 5, "doc_id long, text string")
    pieces = packing.token_pieces(df, VOCABULARY, capacity=512)
    packed = packing.pack(pieces, 512)
    rows = {r.sequence_id: r.ids for r in packing.packed_sequences(packed).collect()}
    places = packed.collect()
    assert sum(map(len, rows.values())) == sum(r.length for r in places)
    for r in places:
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("ranges", [50_000, 40])
@pytest.mark.parametrize("kind", ["mixed", "equal", "small", "tiny", "halves"])
def test_nearly_as_few_sequences_as_best_fit_decreasing(spark, monkeypatch, kind, ranges):
    """Also when a sweep is cut into many ranges, so that leftover pieces and gaps meet by rank."""
    monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
    rng, capacity, n = np.random.default_rng(5), 256, 1200
    lengths = {
        "mixed": rng.integers(1, capacity + 1, n), "equal": np.full(n, 100), "small": rng.integers(1, 30, n), "tiny": np.ones(n, int),
        "halves": rng.choice([128, 127, 129, 85, 86], n),
    }[kind].tolist()
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i long, length long").repartition(5)
    rows = packing.pack(df, capacity).collect()
    sequences = check_places(rows, capacity)
    assert sorted(r.length for r in rows) == sorted(lengths)
    # a range may leave one sequence that is not full
    assert len(sequences) <= 1.03 * best_fit_decreasing(lengths, capacity) + 2 + len(lengths) // ranges


def test_odd_lengths_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 300), (4, 256)], "i long, length long")
    rows = {r.i: r.sequence_id is None for r in packing.pack(df, 256).collect()}
    assert rows == {1: True, 2: True, 3: True, 4: False}
    assert packing.pack(spark.createDataFrame([], "i long, length long"), 256).collect() == []
    assert packing.packing_report(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
