"""Language identification by Bayesian evidence fusion.

* Text: byte trigrams (letters only, hashed to ``BUCKETS``) under a naive Bayes model fitted on a bounded sample of labelled
  rows (``SAMPLE_PER_LANGUAGE`` whole texts of each language, chosen by a hash of the id).
* Declared language (``html lang`` or a metadata column): how often each declaration goes with each language is counted over
  all rows by a grouped aggregation, so an unreliable declaration weighs little.
* Address: priors of the whole table, of the address suffix and of the host are smoothed into each other, each with the strength
  of ``SMOOTHING`` rows; the row itself is left out of its own prior.

``log P(l | row) = text + declared + prior``, normalised over the languages.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.tables import BROADCAST_IDS, without_ids, written
from gustline.llm.words import STEP, in_slices, text_bytes

BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 1000
# A sample is looked for among this many times its size; rows have one of so many places by a hash.
AMPLE, PLACES = 4, 1 << 30
# Neighbouring trigrams share bytes: three of them count as one piece of evidence.
EVIDENCE_PER_TRIGRAM = 1 / 3
SMOOTHING = 20.0
# A row is rejected if no language reaches this share of belief, or if it has no trigram and no declaration.
LEAST_CONFIDENCE = 0.5

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that begins at each byte, and whether it counts (its middle byte is part of a letter)."""
    folded = _FOLD[data].astype(np.uint32)
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64), folded[1:-1] != 0x20


def _sums(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``table[:, bucket]`` over the trigrams of each row, and their number."""
    rows = len(bounds) - 1
    total, number = np.zeros((rows, len(table))), np.zeros(rows, np.int64)
    # a trigram belongs to the row it begins in; the last two bytes of a row begin none
    for low in range(0, max(0, len(data) - 2), STEP):
        high = min(len(data) - 2, low + STEP)
        bucket, counts = trigrams(data[low : high + 2])
        edges = bounds[np.searchsorted(bounds, low, "right") : np.searchsorted(bounds, high + 2, "right")]
        for back in (1, 2):
            cut = edges - back - low
            counts[cut[(cut >= 0) & (cut < len(counts))]] = False
        own = np.searchsorted(bounds, np.arange(low, high)[counts], "right") - 1
        bucket = bucket[counts]
        number += np.bincount(own, minlength=rows)
        for i, weights in enumerate(table):
            total[:, i] += np.bincount(own, weights[bucket], minlength=rows)
    return total, number


def _count(batches):
    for batch in in_slices(batches, 1):
        languages = np.array(batch.column(0).to_pylist(), object)
        for language in set(languages):
            data, bounds = text_bytes(batch.column(1).filter(pa.array(languages == language)))
            counts = np.zeros(BUCKETS, np.int64)
            for i in range(len(bounds) - 1):
                part = data[bounds[i] : bounds[i + 1]]
                for low in range(0, max(0, len(part) - 2), STEP):
                    bucket, keep = trigrams(part[low : min(len(part), low + STEP + 2)])
                    counts += np.bincount(bucket[keep], minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                names=["language", "bucket", "n"],
            )


def fit_languages(labelled: DataFrame, id_column: str, text_column: str, label_column: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from ``SAMPLE_PER_LANGUAGE`` whole texts of each language.

    The model has a row of ``BUCKETS`` numbers per language, whatever the size of the table. Rows that repeat id and text count once, so
    no id, NULL among them, makes the sample larger. Very long texts count whole.
    """
    rows = labelled.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("language"),
                           F.col(f"`{text_column}`").cast("string").alias("text")).where("language is not null")
    # rows are told apart by id and text; what repeats both is one row of the sample
    rows = rows.withColumn("key", F.xxhash64("id", "text")).withColumn("place", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(PLACES)))
    total = rows.groupBy("language").agg(F.count("*").alias("_n"))
    # a share of each language goes on, so that no window holds all rows of one; the share is ample, so the sample is full nearly always
    few = rows.select("language", "place", "key").join(total, "language")
    few = few.where(F.col("place") / F.lit(float(PLACES)) < F.lit(float(AMPLE * SAMPLE_PER_LANGUAGE)) / F.col("_n"))
    order = Window.partitionBy("language").orderBy("place", "key")
    chosen = few.select("language", "place", "key").distinct().withColumn("rank", F.row_number().over(order))
    chosen = chosen.where(F.col("rank") <= SAMPLE_PER_LANGUAGE).select(F.col("key").alias("_key"), F.col("language").alias("_language"))
    chosen = written(chosen, "language-sample")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = rows.join(side, (F.col("key") == F.col("_key")) & (F.col("language") == F.col("_language")))
    sample = sample.groupBy("language", "key").agg(F.any_value("text").alias("text"))
    counts = sample.select("language", "text").mapInArrow(_count, "language string, bucket long, n long")
    found = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["language"].unique())
    table = np.zeros((len(languages), BUCKETS))
    table[np.searchsorted(languages, found["language"]), found["bucket"]] = found["n"]
    return languages, np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def _likelihood(table: np.ndarray, columns: int):
    def run(batches):
        for batch in in_slices(batches, columns):
            data, bounds = text_bytes(batch.column(columns))
            total, number = _sums(data, bounds, table)
            flat = pa.array((total * EVIDENCE_PER_TRIGRAM).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * len(table)), flat)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(columns)], lists, pa.array(number)],
                names=["row_id", "declared", "suffix", "host", "text", "n_trigrams"],
            )

    return run


def _belief(logs: Column) -> Column:
    """Normalised probabilities of an array of logs."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def _summed(values: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(values), F.lit(i))) for i in range(size)])


def identify(
    df: DataFrame,
    model: tuple[list[str], np.ndarray],
    id_column: str,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
) -> DataFrame:
    """One row per input row: ``id_column, language, confidence, n_trigrams, declared, kept``.

    Missing evidence (NULL) says nothing. A row without a trigram and without a declaration is ``und`` with confidence 0 and
    rejected, as is every row if there is no labelled row to fit a model on; a row whose best belief is below
    ``LEAST_CONFIDENCE`` is rejected under its best language. Equal beliefs go to the first language by name. Repeated rows stay. An empty table gives an empty
    result. Other columns are not read. Every trigram of a very long text counts.
    """
    languages, table = model
    k = len(languages)
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("row_id"),
        *[F.lower(c if c is not None else none).alias(n) for n, c in (("declared", declared), ("suffix", suffix), ("host", host))],
        text.cast("string").alias("text"),
    )
    if not k:
        return rows.select(F.col("row_id").alias(id_column), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(0).cast("long").alias("n_trigrams"), "declared", F.lit(False).alias("kept"))
    schema = "row_id long, declared string, suffix string, host string, text array<double>, n_trigrams long"
    rows = written(rows.mapInArrow(_likelihood(table, 4), schema), "language-evidence")
    flat = F.array(*[F.lit(1.0 / k)] * k)
    rows = rows.withColumn("alone", F.when(F.col("n_trigrams") > 0, _belief(F.col("text"))).otherwise(flat))

    # how often a declaration goes with a language: declarations that name a known language are told apart, the rest say nothing
    said = rows.where("n_trigrams > 0 and declared is not null").groupBy("declared").agg(_summed("alone", k).alias("with"))
    said = said.where(F.col("declared").isin(languages)).collect()
    kinds = len(said) + 1
    sums = np.array([r["with"] for r in said]).reshape(len(said), k)
    # each language starts with one row that declares itself
    chance = [
        [math.log((sums[i][j] + (1.0 if r["declared"] == languages[j] else 1.0 / kinds)) / (sums[:, j].sum() + 2.0)) for j in range(k)]
        for i, r in enumerate(said)
    ]
    evidence = F.array(*[F.lit(0.0)] * k)
    for r, logs in zip(said, chance, strict=True):
        evidence = F.when(F.col("declared") == r["declared"], F.array(*[F.lit(x) for x in logs])).otherwise(evidence)

    # priors: table -> suffix -> host, by one aggregation per host and one over its result
    by_host = written(rows.groupBy("suffix", "host").agg(_summed("alone", k).alias("h"), F.count("*").alias("h_n")), "language-hosts")
    by_suffix = by_host.groupBy("suffix").agg(_summed("h", k).alias("s"), F.sum("h_n").alias("s_n"))
    total = by_host.agg(_summed("h", k).alias("t"), F.sum("h_n").alias("n")).first()
    share = [(x + 1.0) / (total["n"] + k) for x in (total["t"] if total["n"] else [0.0] * k)] if total["n"] else [1.0 / k] * k
    hosts = by_host.join(by_suffix.withColumnRenamed("suffix", "_suffix"), F.col("suffix").eqNullSafe(F.col("_suffix")))
    hosts = hosts.select(F.col("suffix").alias("_suffix"), F.col("host").alias("_host"), "h", "h_n", "s", "s_n")
    rows = rows.join(hosts, F.col("suffix").eqNullSafe(F.col("_suffix")) & F.col("host").eqNullSafe(F.col("_host")))
    prior = []
    for i, whole in enumerate(share):
        own = F.get("alone", F.lit(i))
        # NULL suffixes and hosts are no group of their own
        level = F.when(F.col("suffix").isNull(), F.lit(whole)).otherwise(
            (F.get("s", F.lit(i)) - own + SMOOTHING * whole) / (F.col("s_n") - 1 + SMOOTHING)
        )
        level = F.when(F.col("host").isNull(), level).otherwise(
            (F.get("h", F.lit(i)) - own + SMOOTHING * level) / (F.col("h_n") - 1 + SMOOTHING)
        )
        prior.append(F.log(F.greatest(level, F.lit(1e-9))))
    fused = F.zip_with(F.zip_with("text", evidence, lambda a, b: a + b), F.array(*prior), lambda a, b: a + b)
    rows = rows.withColumn("belief", _belief(fused))
    known = (F.col("n_trigrams") > 0) | F.col("declared").isin(languages)
    best = F.array_max("belief")
    names = F.array(*[F.lit(x) for x in languages])
    return rows.select(
        F.col("row_id").alias(id_column),
        F.when(known, F.get(names, (F.array_position("belief", best) - 1).cast("int"))).otherwise("und").alias("language"),
        F.when(known, best).otherwise(0.0).alias("confidence"), "n_trigrams", "declared",
        (known & (best >= LEAST_CONFIDENCE)).alias("kept"),
    )


DECLARED = r"""(?i)<html[^<>]{0,2000}?\slang\s*=\s*["']?([a-z]+)"""
# What is never closed goes on to the end, so no part of a page is searched twice.
MARKUP = r"(?s)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&[#\w]{1,32}+;"
HOST = r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)"


def identify_documents(df: DataFrame) -> DataFrame:
    """:func:`identify` for ``documents``: ``lang`` is the declaration and the label of the fitting sample, ``source`` the host."""
    model = fit_languages(df, "doc_id", "text", "lang")
    return identify(df, model, "doc_id", F.col("text"), F.col("lang"), host=F.col("source"))


def identify_pages(df: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """:func:`identify` for ``pages``: markup is dropped from the text, its ``lang`` declares, the address gives suffix and host."""
    filled = lambda c: F.nullif(c, F.lit(""))
    host = filled(F.regexp_extract(F.lower("url"), HOST, 1))
    return identify(
        df, model, "page_id", F.regexp_replace("html", MARKUP, " "), filled(F.regexp_extract("html", DECLARED, 1)),
        filled(F.regexp_extract(host, r"([^.]+)$", 1)), host,
    )


def known_documents(df: DataFrame) -> DataFrame:
    """The documents whose language is told, with all columns; the rejected ones go. Rows that repeat an id share its fate if any is kept."""
    fate = identify_documents(df).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without_ids(df, "doc_id", fate.where("not kept").select("doc_id"))
