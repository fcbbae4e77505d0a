"""A corpus pipeline: five stages, each applying one operator to all its predecessor kept.

All stages but the last return the columns of ``documents``. Null texts are rejected by the
first stage (their language is unknown); rows are told apart by ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import exactdedup, langid, packing, secretscan, simhash
from cartloom.llm.common import documents, staged, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known: not ``und`` and no close second choice."""
    model = langid.train(docs.filter(~langid.held_out()))
    judged = langid.predict(docs, model)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each text."""
    dropped = exactdedup.duplicates(docs).filter("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of linked fingerprints."""
    dropped = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets blanked out and ``n_chars`` to match."""
    clean = secretscan.redact(secretscan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The language, fingerprint and packing stages are beyond SQL; tests hold the result against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
