"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are words plus one end per document. A token's probability is

    P(class | context) * P(subclass | class, context) * P(word | subclass)

The first two are softmaxes over ``WIDTH`` outcomes whose scores add up weights of hashed context features: the word before
(bigram), the two before (trigram) and the one before the last (skip). The third is the word's smoothed share of its subclass.
Words are put in subclasses by frequency, so that all have about the same mass and frequent words have one of their own; words
outside the ``HEAD_WORDS`` most frequent ones, known or not, share the last subclass. Without training the model is exactly the
smoothed unigram model.

* Counts of all training tokens are one grouped aggregation. The most frequent words and the weights (``CLASS_ROWS`` and
  ``SUBCLASS_ROWS`` times ``WIDTH``) are of fixed size and go to every task; the rest of the vocabulary stays a table and meets the
  rare tokens in a join.
* Training is one pass in ``ROUNDS`` rounds over disjoint parts of the training documents. In a round each task makes AdaGrad
  steps on its part, and the weight changes of all tasks are averaged row by row, weighted by how often a task used the row, in
  a tree of ``FAN_IN`` tasks per group.
* Scoring works on batches of tokens in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.tables import discard, written
from gustline.llm.words import in_slices, mix64, text_bytes, word_hashes

HEAD_WORDS = 1 << 17
WIDTH = 32
CLASS_ROWS, SUBCLASS_ROWS = 1 << 14, 1 << 15
ROUNDS = 3
FAN_IN = 64
BLOCK_ROWS = 1024
RATE = 0.15
TOKENS_AT_ONCE = 4096
SMOOTH = 0.5

_U = np.uint64
# The end of a document as a token, and what stands before its first words. Any fixed numbers that no text hashes to.
END = _U(0x2545F4914F6CDD1D)
START = _U(0x9E6C63D0876A9A47)
_BEFORE, _SKIP, _PAIR = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)
LN10 = math.log(10.0)


def document_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each row's words followed by END, and the n + 1 offsets."""
    words, at = word_hashes(*text_bytes(column))
    rows = len(at) - 1
    tokens = np.full(len(words) + rows, END, _U)
    place = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(at))
    tokens[place] = words
    return tokens, at + np.arange(rows + 1)


class Vocabulary:
    """The head words: smoothed counts, subclasses and shares. Looked up by two tables of slots and a search for the rest."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort([words, -counts])
        words, mass = words[order], counts[order] + SMOOTH
        self.total, self.normaliser = total, total + SMOOTH * (distinct + 1)
        # head words fill the subclasses but the last by cumulative mass; the last holds all other words and the unknown one
        tail = self.normaliser - mass.sum()
        leaves = WIDTH * WIDTH
        before = np.cumsum(mass) - mass
        leaf = np.minimum((before / max(mass.sum(), 1.0) * (leaves - 1)).astype(np.int64), leaves - 2)
        self.leaf_mass = np.bincount(leaf, mass, minlength=leaves).astype(np.float64)
        self.leaf_mass[-1] = tail
        by_word = np.argsort(words)
        self.words, self.leaf = words[by_word], leaf[by_word].astype(np.int16)
        mass = mass[by_word]
        self.log_mass = np.log(mass).astype(np.float64)
        self.log_share = self.log_mass - np.log(self.leaf_mass[self.leaf])
        self._slots()

    def _slots(self):
        bits = max(4, int(len(self.words)).bit_length() + 2)
        self.tables, rest = [], np.arange(len(self.words))
        for level in range(2):
            slot = np.full(1 << bits, -1, np.int32)
            at = (self._spread(self.words[rest], level) >> _U(64 - bits)).astype(np.int64)
            slot[at[::-1]] = rest[::-1]
            self.tables.append((slot, bits))
            rest = rest[slot[at] != rest]
        self.rest = rest

    @staticmethod
    def _spread(tokens: np.ndarray, level: int) -> np.ndarray:
        return tokens if level == 0 else tokens * _U(0x9E3779B97F4A7C15)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index among the head words, or -1."""
        found = np.full(len(tokens), -1, np.int64)
        if not len(self.words):
            return found
        open_ = np.arange(len(tokens))
        for level, (slot, bits) in enumerate(self.tables):
            own = tokens[open_]
            at = slot.take((self._spread(own, level) >> _U(64 - bits)).astype(np.int64)).astype(np.int64)
            hit = (self.words.take(np.maximum(at, 0)) == own) & (at >= 0)
            found[open_[hit]] = at[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            words = self.words[self.rest]
            at = np.minimum(np.searchsorted(words, tokens[open_]), len(words) - 1)
            hit = words[at] == tokens[open_]
            found[open_[hit]] = self.rest[at[hit]]
        return found

    def leaves(self, found: np.ndarray) -> np.ndarray:
        leaf = np.full(len(found), WIDTH * WIDTH - 1, np.int64)
        known = found >= 0
        leaf[known] = self.leaf.take(found[known])
        return leaf


def features(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Three 64-bit context features per token: word before, pair before, word before the last."""
    one = np.empty_like(tokens)
    one[1:] = tokens[:-1]
    one[bounds[:-1]] = START
    two = np.empty_like(tokens)
    two[1:] = one[:-1]
    two[bounds[:-1]] = START
    return np.stack([mix64(one * _BEFORE), mix64(two * _SKIP), mix64(one * _PAIR + two)], axis=1)


class Weights:
    """Biases from the unigram masses and the hashed rows of both softmaxes; class rows first."""

    def __init__(self, leaf_mass: np.ndarray, rows: np.ndarray | None = None):
        mass = np.maximum(leaf_mass.reshape(WIDTH, WIDTH), 1e-9)
        self.class_bias = np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
        self.subclass_bias = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
        self.rows = np.zeros((CLASS_ROWS + SUBCLASS_ROWS, WIDTH), np.float32) if rows is None else rows

    @staticmethod
    def class_rows(context: np.ndarray) -> np.ndarray:
        return (context >> _U(64 - 14)).astype(np.int64)

    @staticmethod
    def subclass_rows(context: np.ndarray, own: np.ndarray) -> np.ndarray:
        mixed = (context ^ (own.astype(_U) * _U(0x9E3779B97F4A7C15))[:, None]) * _U(0xD6E8FEB86659FD93)
        return CLASS_ROWS + (mixed >> _U(64 - 15)).astype(np.int64)

    def _softmax(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Log probabilities of all outcomes."""
        score = self.rows.take(rows[:, 0], axis=0)
        score += bias
        for i in range(1, rows.shape[1]):
            score += self.rows.take(rows[:, i], axis=0)
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        return score

    def log_probability(self, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(subclass) of each token."""
        own, sub = leaf // WIDTH, leaf % WIDTH
        at = np.arange(len(leaf))
        first = self._softmax(self.class_rows(context), self.class_bias)[at, own]
        second = self._softmax(self.subclass_rows(context, own), self.subclass_bias.take(own, axis=0))[at, sub]
        return first.astype(np.float64) + second


class Trainer:
    """AdaGrad steps from given weights; remembers how often each row was used."""

    def __init__(self, weights: Weights):
        self.start, self.weights = weights.rows, weights
        weights.rows = weights.rows.copy()
        self.squares = np.full(len(weights.rows), 1e-2, np.float32)
        self.uses = np.zeros(len(weights.rows), np.int64)

    def step(self, context: np.ndarray, leaf: np.ndarray) -> None:
        w = self.weights
        own, sub = leaf // WIDTH, leaf % WIDTH
        self._descend(w.class_rows(context), w.class_bias, own)
        self._descend(w.subclass_rows(context, own), w.subclass_bias.take(own, axis=0), sub)

    def _descend(self, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        gradient = self.weights._softmax(rows, bias)
        np.exp(gradient, out=gradient)
        gradient[np.arange(len(target)), target] -= 1.0
        used, uses, summed = summed_by_row(rows.T.ravel(), gradient)
        self.uses[used] += uses
        # one step size per row: rows are short and their outcomes are about equally frequent
        squares = self.squares[used] + np.einsum("ij,ij->i", summed, summed) / WIDTH
        self.squares[used] = squares
        summed *= (RATE / np.sqrt(squares))[:, None]
        self.weights.rows[used] -= summed


def summed_by_row(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``rows``, how often each occurs, and the sum of its gradients; entry i belongs to gradient i modulo its length."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    uses = np.diff(np.append(starts, len(ordered)))
    sorted_gradient = gradient.take(order % len(gradient), axis=0)
    summed = sorted_gradient.take(starts, axis=0)
    # most rows occur a few times: add their second, third, ... entries all at once, and the few frequent rows one by one
    open_, at = np.flatnonzero(uses > 1), 1
    while len(open_) > 64:
        summed[open_] += sorted_gradient.take(starts[open_] + at, axis=0)
        at += 1
        open_ = open_[uses[open_] > at]
    for i in open_:
        summed[i] += sorted_gradient[starts[i] + at : starts[i] + uses[i]].sum(axis=0)
    return ordered[starts], uses, summed


def _count_tokens(batches):
    for batch in in_slices(batches, 0):
        tokens, _ = document_tokens(batch.column(0))
        words, counts = np.unique(tokens, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])


def _slices(tokens: np.ndarray, bounds: np.ndarray):
    """Contexts and tokens, ``TOKENS_AT_ONCE`` at a time; contexts cross slices, not documents."""
    for at in range(0, len(tokens), TOKENS_AT_ONCE):
        yield at, min(len(tokens), at + TOKENS_AT_ONCE)


def _train(vocabulary: Vocabulary, weights: Weights):
    def run(batches):
        trainer = Trainer(weights)
        for batch in in_slices(batches, 0):
            tokens, bounds = document_tokens(batch.column(0))
            leaf, context = vocabulary.leaves(vocabulary.find(tokens)), features(tokens, bounds)
            for low, high in _slices(tokens, bounds):
                trainer.step(context[low:high], leaf[low:high])
        if not trainer.uses.any():
            return
        change = (weights.rows - trainer.start).astype(np.float16)
        blocks = range(0, len(change), BLOCK_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // BLOCK_ROWS for b in blocks], pa.int32()),
             pa.array([change[b : b + BLOCK_ROWS].tobytes() for b in blocks], pa.binary()),
             pa.array([trainer.uses[b : b + BLOCK_ROWS].astype(np.float32).tobytes() for b in blocks], pa.binary())],
            names=["block", "change", "uses"],
        )

    return run


def _mean_change(changes, uses) -> tuple[np.ndarray, np.ndarray]:
    """Mean change of each row, weighted by its uses, and their sum."""
    total, weight = np.zeros((BLOCK_ROWS, WIDTH)), np.zeros(BLOCK_ROWS)
    for c, u in zip(changes, uses, strict=True):
        times = np.frombuffer(u, np.float32).astype(np.float64)
        total += np.frombuffer(c, np.float16).reshape(-1, WIDTH) * times[:, None]
        weight += times
    return total / np.maximum(weight, 1)[:, None], weight


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    change, uses = _mean_change(rows["change"], rows["uses"])
    return pd.DataFrame(
        {"block": [key[0]], "change": [change.astype(np.float16).tobytes()], "uses": [uses.astype(np.float32).tobytes()], "task": [key[1]]}
    )


def _round(training: DataFrame, vocabulary: Vocabulary, weights: Weights) -> Weights:
    """One synchronous round: weights after averaging the changes of all tasks."""
    schema = "block int, change binary, uses binary"
    found = training.select("text").mapInArrow(_train(vocabulary, weights), schema)
    found = written(found.withColumn("task", F.spark_partition_id()), "lm-changes")
    tasks = (found.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        grouped = found.withColumn("task", F.expr(f"task div {FAN_IN}")).groupBy("block", "task")
        fewer = written(grouped.applyInPandas(_add, schema + ", task int"), "lm-changes")
        discard(found)
        found, tasks = fewer, -(-tasks // FAN_IN)
    rows = weights.rows.copy()
    for part in found.collect():  # as large as the weights, whatever the number of tasks
        at = part["block"] * BLOCK_ROWS
        rows[at : at + BLOCK_ROWS] += np.frombuffer(part["change"], np.float16).reshape(-1, WIDTH).astype(np.float32)
    discard(found)
    fresh = object.__new__(Weights)
    fresh.class_bias, fresh.subclass_bias, fresh.rows = weights.class_bias, weights.subclass_bias, rows
    return fresh


def _score(vocabulary: Vocabulary, weights: Weights):
    tail_share = -math.log(vocabulary.leaf_mass[-1])

    def run(batches):
        for batch in in_slices(batches, 1):
            tokens, bounds = document_tokens(batch.column(1))
            rows = len(bounds) - 1
            found, context = vocabulary.find(tokens), features(tokens, bounds)
            known, leaf = found >= 0, vocabulary.leaves(found)
            model = np.empty(len(tokens))
            for low, high in _slices(tokens, bounds):
                model[low:high] = weights.log_probability(context[low:high], leaf[low:high])
            base = np.zeros(len(tokens))
            base[known] = vocabulary.log_mass.take(found[known])
            model[known] += vocabulary.log_share.take(found[known])
            model[~known] += tail_share
            per_row = lambda x: np.add.reduceat(x, bounds[:-1])
            rare_rows = np.searchsorted(bounds, np.flatnonzero(~known), "right") - 1
            rare = tokens[~known].view(np.int64)
            words, counts = [], []
            cuts = np.searchsorted(rare_rows, np.arange(rows + 1))
            for i in range(rows):
                w, c = np.unique(rare[cuts[i] : cuts[i + 1]], return_counts=True)
                words.append(w)
                counts.append(c.astype(np.int32))
            n_tokens = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens), pa.array(per_row(known.astype(np.int64)).astype(np.int64)),
                 pa.array(per_row(base) - n_tokens * math.log(vocabulary.normaliser)), pa.array(per_row(model)),
                 pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                names=["id", "n_tokens", "n_head", "base", "model", "rare", "rare_n"],
            )

    return run


def held_out_of(id_column: Column, folds: int = 5, fold: int = 1) -> Column:
    """True for rows that training does not see; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(training: DataFrame) -> tuple[Vocabulary, Weights, DataFrame]:
    """Model and token counts of a table with ``part`` (round, from 0) and ``text``. No training text gives a uniform model."""
    counts = training.select("text").mapInArrow(_count_tokens, "token long, n long")
    counts = written(counts.groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the words above the count at which they would be more than HEAD_WORDS; found from how many words have each count
    histogram = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    above = histogram.limit(HEAD_WORDS).collect()  # each entry is a word at least
    words, least = 0, 0
    for r in above:
        words += r["words"]
        least = r["n"]
        if words > HEAD_WORDS:
            break
    head = counts.where((F.col("n") > least) if words > HEAD_WORDS else F.lit(bool(above))).toPandas()
    vocabulary = Vocabulary(
        head["token"].to_numpy().astype(np.int64).view(_U), head["n"].to_numpy().astype(np.float64), size["n"] or 0, size["v"]
    )
    weights = Weights(vocabulary.leaf_mass)
    for part in range(ROUNDS):
        weights = _round(training.where(F.col("part") == part), vocabulary, weights)
    return vocabulary, weights, counts


def score_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per input row: ``id_column, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the log10 probability under the smoothed unigram model of the training tokens, ``score`` that under the
    trained model; both count the end of the document. A NULL or empty text is the end alone. Repeated rows stay, a NULL id is in training.
    An empty table gives an empty result. Very long texts are scored whole. Other columns are not read. Steps of training tasks are averaged,
    so ``score`` depends on the number of partitions.
    """
    held = held_out if held_out is not None else held_out_of(F.col(f"`{id_column}`"))
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), held.alias("held"))
    training = docs.where("not held").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(ROUNDS)))
    vocabulary, weights, counts = fit(training)
    schema = "id long, n_tokens long, n_head long, base double, model double, rare array<long>, rare_n array<int>"
    scored = docs.select("id", "text").mapInArrow(_score(vocabulary, weights), schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    # words outside the head meet their counts in the table of all words
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("times")
    )
    met = rare.join(counts, "token", "left")
    mass = F.log(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    met = met.groupBy("row").agg(
        F.sum(F.col("times") * mass).alias("rare_mass"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known")
    )
    rows = scored.drop("rare", "rare_n").join(met, "row", "left")
    extra = F.coalesce("rare_mass", F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_column),
        (held_out if held_out is not None else held_out_of(F.col("id"))).alias("held_out"),
        "n_tokens", (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        ((F.col("base") + extra) / LN10).alias("base_score"), ((F.col("model") + extra) / LN10).alias("score"),
    )
