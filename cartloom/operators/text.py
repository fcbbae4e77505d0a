"""TF-IDF over short or long texts and its truncated SVD."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.words import STOP_WORDS
from cartloom.operators.svd import Svd, truncated_svd
from cartloom.sources.stage import scratch_path

# Runs of two or more letters, digits or underscores in any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS = 1000


def tokens(text: Column) -> Column:
    """Lower-case words of at least two characters, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Vocabulary:
    """Chosen terms in alphabetical order with their idf."""

    terms: list[str]
    idf: list[float]


def term_counts(texts: DataFrame, words: str = "words") -> DataFrame:
    """Occurrences and texts per term.

    The words of a text are followed by its distinct words, so one exploded pass gives
    both counts, combined in the map tasks.
    """
    each = texts.select(
        F.size(words).alias("n"),
        F.posexplode(F.concat(words, F.array_distinct(words))).alias("pos", "term"),
    )
    is_word = F.col("pos") < F.col("n")
    return each.groupBy("term").agg(
        F.count(F.when(is_word, 1)).alias("n_total"), F.count(F.when(~is_word, 1)).alias("n_texts")
    )


def fit_vocabulary(
    texts: DataFrame,
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
    words: str = "words",
) -> Vocabulary:
    """The ``max_terms`` most frequent terms (ties by term) with smoothed idf.

    idf = ln((1 + texts) / (1 + texts with the term)) + 1. Stop words are dropped from
    the counted terms, not word by word from the texts: a word outside the vocabulary
    does not enter a vector anyway. At most ``max_terms`` rows reach the driver.
    """
    n = texts.count()
    counts = term_counts(texts, words)
    if stop_words:
        counts = counts.filter(~F.col("term").isin(list(stop_words)))
    top = counts.orderBy(F.desc("n_total"), "term").limit(max_terms).collect()
    chosen = sorted((r["term"], r["n_texts"]) for r in top)
    return Vocabulary(
        terms=[t for t, _ in chosen],
        idf=[float(np.log((1 + n) / (1 + df)) + 1) for _, df in chosen],
    )


def tfidf_vectors(texts: DataFrame, vocabulary: Vocabulary, words: str = "words") -> DataFrame:
    """Adds ``tfidf``, a sparse unit-length vector per text. Moves no rows."""
    if not vocabulary.terms:
        raise ValueError("no terms left after removing stop words")
    counts = CountVectorizerModel.from_vocabulary(
        vocabulary.terms, inputCol=words, outputCol="_tf"
    ).transform(texts)
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_tf", outputCol="_weighted"
    ).transform(counts)
    return (
        Normalizer(p=2.0, inputCol="_weighted", outputCol="tfidf")
        .transform(weighted)
        .drop("_tf", "_weighted")
    )


def _entries(vector: str) -> Column:
    """Non-zero (index, weight) entries of a sparse vector column."""
    v = F.unwrap_udt(F.col(vector))
    return F.arrays_zip(v["indices"].alias("i"), v["values"].alias("w"))


def with_words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, tokens(F.col(text)).alias("words"))


def tfidf(
    df: DataFrame,
    key: str = "product_id",
    text: str = "product_name",
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """TF-IDF weights in long form: key, term, weight."""
    texts = with_words(df, key, text)
    vocabulary = fit_vocabulary(texts, max_terms, stop_words)
    terms = F.array(*[F.lit(t) for t in vocabulary.terms])
    return (
        tfidf_vectors(texts, vocabulary)
        .select(key, F.explode(_entries("tfidf")).alias("e"))
        .select(key, F.element_at(terms, F.col("e.i") + 1).alias("term"), F.col("e.w").alias("weight"))
        .filter(F.col("weight") != 0)
    )


def text_features(
    df: DataFrame,
    key: str = "product_id",
    text: str = "product_name",
    n_components: int = 10,
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``text_svd_0..n-1`` per row: TF-IDF projected on its leading right singular vectors, whose
    signs are arbitrary and so chosen: the largest loading is positive."""
    found = text_svd(df, key, text, n_components, max_terms, stop_words)
    parts = [F.col("scores")[c].alias(f"text_svd_{c}") for c in range(n_components)]
    return found.scores.select(key, *parts)


def text_svd(
    df: DataFrame,
    key: str = "product_id",
    text: str = "product_name",
    n_components: int = 10,
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> Svd:
    """The truncated decomposition of the TF-IDF rows of a text column."""
    rows, vocabulary = tfidf_rows(df, key, text, max_terms, stop_words)
    if n_components > len(vocabulary.terms):
        raise ValueError(f"{n_components} components from {len(vocabulary.terms)} terms")
    return truncated_svd(rows, key, n_components, len(vocabulary.terms))


def tfidf_rows(
    df: DataFrame,
    key: str = "product_id",
    text: str = "product_name",
    max_terms: int = MAX_TERMS,
    stop_words: Sequence[str] = STOP_WORDS,
) -> tuple[DataFrame, Vocabulary]:
    """A row per text with term numbers ``i`` and weights ``w``. Texts are spread over the tasks and cut into
    words once, and the matrix is written: what follows reads it many times."""
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    texts = with_words(df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df, key, text)
    path = scratch_path(spark, f"words-{uuid.uuid4().hex}")
    texts.write.parquet(path)
    texts = spark.read.schema(texts.schema).parquet(path)
    vocabulary = fit_vocabulary(texts, max_terms, stop_words)
    v = F.unwrap_udt(F.col("tfidf"))
    rows = tfidf_vectors(texts, vocabulary).select(key, v["indices"].alias("i"), v["values"].alias("w"))
    path = scratch_path(spark, f"tfidf-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), vocabulary
