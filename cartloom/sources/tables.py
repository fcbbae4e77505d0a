"""Readers and writers of the six-table layout (CSV as shipped, or parquet)."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cartloom.schemas import ROW_ORDER, TABLES

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Tables:
    """The six input tables, in the order of ``schemas.TABLES``."""

    orders: DataFrame
    prior: DataFrame
    train: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders,
            "order_products__prior": self.prior,
            "order_products__train": self.train,
            "products": self.products,
            "aisles": self.aisles,
            "departments": self.departments,
        }


def pick(
    df: DataFrame,
    usecols: Sequence[str] | None = None,
    nrows: int | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Column subset and row limit of a scan.

    A plain ``limit`` returns whichever rows arrive first, so the limit follows
    ``order_by`` (all columns if not given) and repeats exactly.
    """
    if nrows is not None:
        df = df.orderBy(*(order_by or df.columns)).limit(nrows)
    return df.select(*usecols) if usecols else df


def load_table(
    spark: SparkSession,
    root: str | Sequence[str],
    name: str,
    usecols: Sequence[str] | None = None,
    nrows: int | None = None,
    fmt: str = "csv",
    permissive: bool = False,
) -> DataFrame:
    """One table by its declared schema; its columns may come in any order.

    ``root`` may be several folders whose files are read as one table. File splits
    play the part of chunked reading. A missing path, a missing column and a value that is
    not of its column's type raise (the last when the rows are read). With ``permissive``
    the first two are logged and an empty frame with the declared columns comes back, and bad
    values are null, their rows counted in the log.
    """
    schema = TABLES[name]
    roots = [root] if isinstance(root, str) else list(root)
    paths = [f"{r.rstrip('/')}/{name}.{fmt}" for r in roots]
    try:
        if fmt == "csv":
            parts = [read_csv(spark, path, schema, permissive) for path in paths]
            df = reduce(DataFrame.unionByName, parts)
        else:
            df = spark.read.schema(schema).format(fmt).load(paths)
    except (AnalysisException, MissingColumn) as error:
        if not permissive:
            raise
        log.error("failed to load %s: %s", name, error)
        df = spark.createDataFrame([], schema)
    return pick(df, usecols, nrows, ROW_ORDER[name])


def load_all(
    spark: SparkSession, root: str, fmt: str = "csv", permissive: bool = False
) -> Tables:
    """All six tables."""
    loaded = [load_table(spark, root, n, fmt=fmt, permissive=permissive) for n in TABLES]
    return Tables(*loaded)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


class MissingColumn(ValueError):
    """A file lacks a declared column."""


def read_csv(
    spark: SparkSession, path: str, schema: StructType, permissive: bool = False
) -> DataFrame:
    """The columns of ``schema`` from CSV files with a header row, found by name.

    All files under ``path`` must have the same header. Other columns are ignored.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    header = reader.csv(path).columns  # the first line alone is read
    missing = [c for c in schema.names if c not in header]
    if missing:
        raise MissingColumn(f"{path} has no column {', '.join(missing)}")
    # a header that differs in a later file is an error too
    reader = reader.option("enforceSchema", False)
    if not permissive:
        typed = [schema[c] if c in schema.names else StructField(c, StringType()) for c in header]
        return reader.option("mode", "FAILFAST").schema(StructType(typed)).csv(path).select(*schema.names)
    text = reader.schema(StructType([StructField(c, StringType()) for c in header])).csv(path)
    values = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    bad = reduce(or_, [F.col(c).isNotNull() & v.isNull() for c, v in values.items()])
    found = text.filter(bad).count()
    if found:
        log.warning("%s: %d rows with values of another type, which are null", path, found)
    return text.select(*[v.alias(c) for c, v in values.items()])
