"""Repeatable samples and splits: the outcome depends on keys, never on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.columns import hash_key, hash_percent


def known_user_ids(orders: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` distinct user ids."""
    return (
        orders.filter(F.col("user_id").isNotNull())
        .select("user_id")
        .distinct()
        .orderBy("user_id")
        .limit(n)
    )


def sample_users(orders: DataFrame, n: int = 1500, seed: int = 42) -> DataFrame:
    """``n`` users (all, if fewer) in a seeded hash order."""
    users = orders.filter(F.col("user_id").isNotNull()).select("user_id").distinct()
    return users.orderBy(hash_key("user_id", seed=seed), "user_id").limit(n)


def hash_split(
    df: DataFrame, keys: tuple[str, ...] = ("user_id", "product_id"), test_pct: int = 20, seed: int = 42
) -> DataFrame:
    """Adds ``split``: 'test' for about ``test_pct`` % of the keys, else 'train'."""
    held = hash_percent(*keys, seed=seed) < test_pct
    return df.withColumn("split", F.when(held, "test").otherwise("train"))


def temporal_split(orders: DataFrame) -> DataFrame:
    """Adds ``split``: 'holdout' for each user's last order, else 'history'.

    The last number per user is a small aggregate, joined back on (user, number), which
    is unique per order: no window has to hold one user's orders.
    """
    last = (
        orders.groupBy("user_id")
        .agg(F.max("order_number").alias("order_number"))
        .withColumn("split", F.lit("holdout"))
    )
    return orders.join(last, ["user_id", "order_number"], "left").withColumn(
        "split", F.coalesce("split", F.lit("history"))
    )


def split_by_eval_set(orders: DataFrame) -> dict[str, DataFrame]:
    """The orders of each evaluation set."""
    return {n: orders.filter(F.col("eval_set") == n) for n in ("prior", "train", "test")}
