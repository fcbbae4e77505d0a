"""Write-once intermediate tables in the cluster's shared folder.

A table that several jobs read (the mapped order lines, the user×product totals) is
written as parquet once per application and read back, so its lineage ends at files
that outlive any executor and every reader gets column pruning and pushdown.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import threading
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8

_lock = threading.RLock()
_written: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master, whose executors share the machine, may leave it unset and then gets a
    temporary folder; on a cluster each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = f"folder:{spark.sparkContext.applicationId}"
    with _lock:
        if key not in _written:
            folder = tempfile.mkdtemp(prefix="cartloom-")
            spark.sparkContext.setCheckpointDir(folder)
            _written[key] = folder
        return str(_written[key])


def bucket_count(size: int) -> int:
    """A power of two of buckets of about ``BUCKET_BYTES``, ``LEAST_BUCKETS`` at least."""
    return 1 << max(math.ceil(math.log2(max(size, 1) / BUCKET_BYTES)), math.ceil(math.log2(LEAST_BUCKETS)))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a source table is read from, as its plan lists them; reads no rows."""
    return int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())


def staged(
    spark: SparkSession,
    name: str,
    origin: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    bucket_by: str = "",
    size: Callable[[], int] | None = None,
) -> DataFrame:
    """``build()`` written once per application and ``origin``, then read from parquet.

    With ``bucket_by`` the table, about ``size()`` bytes, is laid out in ``bucket_count`` files
    per partition by the hash of that column, so joins and group-bys on it need no shuffle
    of this table. Use it for keys with few rows each (an order, a user's pairs).
    """
    app = spark.sparkContext.applicationId
    tag = hashlib.md5(origin.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/cartloom/{app}/{tag}/{name}"
    table = _table_name(spark, path)
    with _lock:
        if path not in _written:
            df = build()
            buckets = bucket_count(size() if size else 0) if bucket_by else 0
            if buckets:
                # the writer's bucket id is this partition id: one file per bucket
                writer = df.repartition(buckets, bucket_by).write.mode("overwrite")
                writer = writer.option("path", path).bucketBy(buckets, bucket_by)
                writer.partitionBy(*partition_by).format("parquet").saveAsTable(table)
            else:
                df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            _written[path] = None if buckets else df.schema
        schema = _written[path]
    return spark.table(table) if schema is None else spark.read.schema(schema).parquet(path)


def staged_model(
    spark: SparkSession, name: str, origin: str, fit: Callable[[], PipelineModel]
) -> PipelineModel:
    """``fit()`` saved once per application and ``origin``, then loaded."""
    tag = hashlib.md5(origin.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/cartloom/{spark.sparkContext.applicationId}/{tag}/{name}"
    with _lock:
        if path not in _written:
            fit().write().overwrite().save(path)
            _written[path] = name
    return PipelineModel.load(path)


def staged_folder(spark: SparkSession, name: str, origin: str, write: Callable[[str], None]) -> str:
    """A folder that ``write`` fills once per application and ``origin``."""
    tag = hashlib.md5(origin.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/cartloom/{spark.sparkContext.applicationId}/{tag}/{name}"
    with _lock:
        if path not in _written:
            write(path)
            _written[path] = name
    return path


def forget_staged(spark: SparkSession) -> None:
    """Drop this application's bucketed tables from the catalog and forget what is staged.

    Their files stay in the shared folder under the application id.
    """
    prefix = f"{shared_folder(spark)}/cartloom/{spark.sparkContext.applicationId}/"
    with _lock:
        for path in [p for p in _written if p.startswith(prefix)]:
            if _written.pop(path) is None:
                spark.sql(f"DROP TABLE IF EXISTS {_table_name(spark, path)}")


def _table_name(spark: SparkSession, path: str) -> str:
    app, tag, name = path.split("/")[-3:]
    return f"cartloom_{app}_{tag}_{name}".replace("-", "_")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a sink that a job rewrites."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/cartloom/{app}/{name}"
