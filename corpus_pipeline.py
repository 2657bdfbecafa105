"""Documents to packed training sequences: language, near-duplicates, secrets, mix, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its predecessor kept. All stages but the last return the
columns of ``documents``; a document that the mix takes twice has two rows from there on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustline.llm import language, mixing, near_dedup, packing, secrets
from gustline.llm.queries import vocabulary
from gustline.llm.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return language.known_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the weight of their source: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packing_report(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", tell_language),
    ("minhash_near_dedup", drop_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]
# Stages use models, fingerprints and tokenizers that SQL cannot express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
