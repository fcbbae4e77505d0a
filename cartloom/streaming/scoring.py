"""Answer a stream of JSON requests from the ranked lists of the last batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartloom.operators.recommend import score_requests

REQUEST_ID = "request_id"


def read_requests(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Text files, one JSON request per line, with the file each came from."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    )


def score_lines(
    lines: DataFrame,
    ranked: DataFrame,
    by_product: DataFrame,
    products: DataFrame | None,
) -> DataFrame:
    """One response per request line (columns file, raw).

    Equal lines of a file are scored once and answered as often as they occur, so a
    request sent over and over does not pile up on its user's join key.
    """
    asked = (
        lines.groupBy("file", "raw")
        .agg(F.count(F.lit(1)).cast("int").alias("copies"))
        .withColumn(REQUEST_ID, F.sha2(F.concat_ws("|", "file", "raw"), 256))
    )
    responses = score_requests(
        asked.select(REQUEST_ID, "raw"), ranked, by_product, products, "raw", REQUEST_ID
    )
    return asked.join(responses, REQUEST_ID).select(
        "file", "raw", F.explode(F.array_repeat("response", F.col("copies"))).alias("response")
    )


def score_stream(
    requests: DataFrame,
    ranked: DataFrame,
    by_product: DataFrame,
    products: DataFrame | None,
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score each micro-batch with the batch operator and write its responses.

    Each batch overwrites its own ``batch_id`` folder, so a batch replayed after a
    failure leaves its answers once. No state is kept between batches. ``ranked`` and
    ``by_product`` should be written tables, as they are joined in every batch.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            (
                score_lines(batch, ranked, by_product, products)
                .write.mode("overwrite")
                .parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
            )
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
