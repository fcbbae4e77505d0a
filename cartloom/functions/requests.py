"""Scoring requests as JSON text: parsing and answering with JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the request fields and the two mode texts.
DEFAULT_TOP_K = 10
DEFAULT_THRESHOLD = 0.0
COLD_MODE = "Global Popularity"
PERSONAL_MODE = "Personalized"
EMPTY_RECORDS = "Empty or invalid dataframe_records"


def _kind(doc: Column, path: str) -> Column:
    """Type name of the value at ``path``; null if the key is missing."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _integer(doc: Column, path: str) -> Column:
    """Whole numbers, numbers cut towards 0, digit strings, booleans; else null."""
    kind, text = _kind(doc, path), F.trim(_text(doc, path))
    return (
        F.when(kind == "BIGINT", F.try_variant_get(doc, path, "long"))
        .when(_number(kind), F.try_variant_get(doc, path, "double").try_cast("long"))
        .when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean").cast("long"))
        .when((kind == "STRING") & text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    )


def _real(doc: Column, path: str) -> Column:
    kind = _kind(doc, path)
    return (
        F.when(_number(kind), F.try_variant_get(doc, path, "double"))
        .when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean").cast("double"))
        .when(kind == "STRING", F.trim(_text(doc, path)).try_cast("double"))
    )


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_requests(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``user_id``, ``top_k``, ``threshold`` and ``error`` to a table of requests.

    A request is one object or ``{"dataframe_records": [object, ...]}``, whose first
    record counts. Missing top_k and threshold take defaults; a field that is present but
    is not a number (null included), a missing user_id or broken text is an error.
    """

    def opened(d: Column) -> Column:
        records = _kind(d, "$.dataframe_records")
        first = F.try_variant_get(d, "$.dataframe_records[0]", "variant")
        none = records.isNotNull() & (~records.startswith("ARRAY") | first.isNull())
        return F.struct(
            d.isNotNull().alias("ok"),
            F.coalesce(none, F.lit(False)).alias("no_record"),
            F.when(records.isNotNull(), first).otherwise(d).alias("request"),
        )

    def fields(o: Column) -> Column:
        r = o["request"]
        k, t = _kind(r, "$.top_k"), _kind(r, "$.threshold")
        return F.struct(
            o["ok"].alias("ok"),
            o["no_record"].alias("no_record"),
            _integer(r, "$.user_id").alias("user_id"),
            F.when(k.isNull(), DEFAULT_TOP_K).otherwise(_integer(r, "$.top_k")).alias("top_k"),
            F.when(t.isNull(), DEFAULT_THRESHOLD).otherwise(_real(r, "$.threshold")).alias("threshold"),
        )

    def judged(f: Column) -> Column:
        error = (
            F.when(~f["ok"], "Invalid input format: not JSON")
            .when(f["no_record"], EMPTY_RECORDS)
            .when(f["user_id"].isNull(), "Invalid input format: user_id")
            .when(f["top_k"].isNull() | (f["top_k"] < 0), "Invalid input format: top_k")
            .when(f["threshold"].isNull(), "Invalid input format: threshold")
        )
        good = error.isNull()
        return F.struct(
            *[F.when(good, f[c]).alias(c) for c in ("user_id", "top_k", "threshold")],
            error.alias("error"),
        )

    answer = _bind(_bind(_bind(F.try_parse_json(raw), opened), fields), judged)
    return requests.select(*requests.columns, answer.alias("_parsed")).select(
        *requests.columns, "_parsed.*"
    )


def response_json() -> Column:
    """JSON answer from columns user_id, mode, predictions and error; nulls are kept."""
    answer = F.to_json(
        F.struct("user_id", "mode", "predictions"), {"ignoreNullFields": "false"}
    )
    return F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(answer)
