"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import (
    exactdedup,
    langid,
    licenses,
    packing,
    piecebpe,
    quality,
    runs,
    secretscan,
    simhash,
    substringdedup,
    tokencount,
    tokenfile,
    turnrepair,
)
from cartloom.llm.common import documents, tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        documents(spark, sf_dir), tokenizer_file(BYTE_BPE), end_id=2, capacity=1024
    )


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


ORACLE_SQL["op2_license_scan"] = licenses.sql()


@query
def op2_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses anywhere in a text, which the units of the scan and its SQL miss."""
    return licenses.passages(documents(spark, sf_dir))


@query
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfile.round_trip(documents(spark, sf_dir), tokenizer_file(BYTE_BPE), end_id=0)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return piecebpe.digests(docs, tokenizer_file(PIECE_BPE))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(documents(spark, sf_dir))


ORACLE_SQL["op6_exact_dedup"] = """
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM normal
"""


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substringdedup.remove(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secretscan.scan(documents(spark, sf_dir)).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"] != "random")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secretscan.listed(base), 256).alias("base_sha256"),
        secretscan.listed(F.col("spans")).alias("spans"),
    )


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turnrepair.digests(conversations, turnrepair.repair(turnrepair.damage(conversations)))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokencount.token_counts(docs, tokenizer_file(PIECE_BPE), most=4096)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return runs.digests(docs, planted=runs.planted_number())
