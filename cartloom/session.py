"""Session defaults for jobs started from this repo (tests, bench, spark-submit)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cartloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything in ``conf`` (dots as ``__``) wins.

    On a cluster leave ``master`` to spark-submit. AQE picks the number of reduce
    tasks and splits skewed join partitions, so the shuffle partition count is only
    an upper bound there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
