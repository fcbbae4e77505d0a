"""Saved model package: model, feature order and the tables scoring needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

PARTS = ("user_features", "product_features", "orders", "prior", "products")


@dataclass(frozen=True)
class Package:
    model: PipelineModel
    features: list[str]
    user_features: DataFrame
    product_features: DataFrame
    orders: DataFrame
    prior: DataFrame
    products: DataFrame


def save_package(package: Package, path: str) -> None:
    """Write every part under ``path``: the model in ML format, tables as parquet."""
    spark = package.orders.sparkSession
    package.model.write().overwrite().save(f"{path}/model")
    meta = [(i, name) for i, name in enumerate(package.features)]
    spark.createDataFrame(meta, "position int, feature string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/features")
    for part in PARTS:
        getattr(package, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load_package(spark: SparkSession, path: str) -> Package:
    """Read back a saved package; its tables stay lazy."""
    features = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return Package(
        model=PipelineModel.load(f"{path}/model"),
        features=[r["feature"] for r in features],
        **{part: spark.read.parquet(f"{path}/{part}") for part in PARTS},
    )
