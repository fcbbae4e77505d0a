"""View of the star-schema tables (orders, lineitem, part) as the six input tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.columns import same_within
from cartloom.functions.ranking import GROUP_ROWS, dense_numbers, number_sequence
from cartloom.schemas import ORDER_PRODUCTS, ORDERS
from cartloom.sources.stage import bucket_count, input_bytes, staged
from cartloom.sources.tables import Tables

#: Bytes in a group-by (keys, sums and their place in the map) per byte of a source file: an order
#: line takes some 17 bytes in a file and 130 and more in memory.
UNPACKED = 8


def product_of(part_key: Column) -> Column:
    """Many part keys to few product ids, with popular low ids."""
    x = part_key % 200
    return F.floor(x * x * x / 40000).cast("long")


def map_orders(raw: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Orders with their place in the user's sequence, gap and evaluation set."""
    base = raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("placed"),
    )
    seq = number_sequence(base, "user_id", "placed", "order_id", group_rows)
    held_out = F.when(F.col("user_id") % 3 != 0, "train").otherwise("test")
    return seq.select(
        "order_id",
        "user_id",
        F.when(F.col("is_last"), held_out).otherwise("prior").alias("eval_set"),
        F.col("position").cast("int").alias("order_number"),
        (F.dayofweek("placed") - 1).alias("order_dow"),
        (F.col("order_id") % 24).cast("int").alias("order_hour_of_day"),
        (F.datediff("placed", "previous") % 31).cast("double").alias("days_since_prior_order"),
    )


def map_lines(raw: DataFrame, orders: DataFrame, buckets: int = 0) -> DataFrame:
    """One row per (order, product) with cart position, user and order number.

    With ``buckets``, those of ``orders`` by order, the folded lines are dealt to them once, for the
    window, the join and a writer that lays them out alike.

    The group-by folds repeated lines in the map tasks, so what is left of one order
    is at most one row per catalogue product and the window over it is bounded.
    """
    lines = (
        raw.select(
            F.col("l_orderkey").alias("order_id"),
            product_of(F.col("l_partkey")).alias("product_id"),
            "l_linenumber",
        )
        .groupBy("order_id", "product_id")
        .agg(F.min("l_linenumber").alias("ln"))
    )
    lines = lines.repartition(buckets, "order_id") if buckets else lines
    cart = Window.partitionBy("order_id").orderBy("ln", "product_id")
    return lines.select(
        "order_id", "product_id", F.row_number().over(cart).alias("add_to_cart_order")
    ).join(orders.select("order_id", "user_id", "order_number", "eval_set"), "order_id")


def flag_reorders(lines: DataFrame) -> DataFrame:
    """``reordered`` = 0 on the first purchase of a pair, else 1.

    The first order number per pair, and its order, are partial aggregates. A user has one order of a
    number, so they are joined back where the lines of that order lie, without moving the lines: a user or
    a pair with a great share of the lines puts no extra load on any task.
    """
    first = (
        lines.groupBy("user_id", "product_id")
        .agg(F.min("order_number").alias("_number"), F.min_by("order_id", "order_number").alias("_order"))
        .select(F.col("user_id").alias("_user"), F.col("product_id").alias("_product"), "_number", "_order")
        .withColumn("is_new", F.lit(0))
    )
    there = (
        (F.col("order_id") == F.col("_order"))
        & same_within("product_id", "_product")
        & same_within("user_id", "_user")
        & same_within("order_number", "_number")
    )
    return lines.join(first, there, "left").select(
        "order_id",
        "product_id",
        "add_to_cart_order",
        F.coalesce("is_new", F.lit(1)).alias("reordered"),
        "eval_set",
    )


def map_products(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, aisles and departments; metadata comes from the smallest part key."""
    first = part.groupBy(product_of(F.col("p_partkey")).alias("product_id")).agg(
        F.min_by(F.struct("p_name", "p_brand", "p_type"), "p_partkey").alias("m")
    )

    def dense_ids(column: str, id_name: str, name: str) -> DataFrame:
        return dense_numbers(part.select(F.col(column).alias(name)), name, id_name)

    aisles = dense_ids("p_brand", "aisle_id", "aisle")
    departments = dense_ids("p_type", "department_id", "department")
    products = (
        first.select(
            "product_id",
            F.concat_ws(" ", "m.p_name", "m.p_type").alias("product_name"),
            F.col("m.p_brand").alias("aisle"),
            F.col("m.p_type").alias("department"),
        )
        .join(aisles, "aisle")
        .join(departments, "department")
        .select("product_id", "product_name", "aisle_id", "department_id")
    )
    return products, aisles, departments


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Star:
    """The six tables of one data folder, each mapped and staged when first asked for.

    Orders and lines share their buckets by order, the key that every feature job joins
    them on.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)

    def _staged(self, name: str, build, **layout) -> DataFrame:
        return staged(self.spark, name, self.sf_dir, build, **layout)

    def size(self) -> int:
        """Bytes that the rows of the largest table take in a group-by."""
        return UNPACKED * input_bytes(self._raw("lineitem"))

    @cached_property
    def orders(self) -> DataFrame:
        return self._staged(
            "orders",
            lambda: map_orders(self._raw("orders")),
            partition_by=["eval_set"],
            bucket_by="order_id",
            size=self.size,
        ).select(*ORDERS.names)

    @cached_property
    def order_products(self) -> DataFrame:
        def build() -> DataFrame:
            lines = self._staged(
                "lines",
                lambda: map_lines(self._raw("lineitem"), self.orders, bucket_count(self.size())),
                bucket_by="order_id",
                size=self.size,
            )
            return flag_reorders(lines)

        return self._staged(
            "order_products",
            build,
            partition_by=["eval_set"],
            bucket_by="order_id",
            size=self.size,
        )

    def _lines_of(self, eval_set: str) -> DataFrame:
        chosen = self.order_products.filter(F.col("eval_set") == eval_set)
        return chosen.select(*ORDER_PRODUCTS.names)

    @property
    def prior(self) -> DataFrame:
        return self._lines_of("prior")

    @property
    def train(self) -> DataFrame:
        return self._lines_of("train")

    @cached_property
    def products(self) -> DataFrame:
        return self._staged("products", lambda: map_products(self._raw("part"))[0])

    @cached_property
    def aisles(self) -> DataFrame:
        return self._staged("aisles", lambda: map_products(self._raw("part"))[1])

    @cached_property
    def departments(self) -> DataFrame:
        return self._staged("departments", lambda: map_products(self._raw("part"))[2])

    def tables(self) -> Tables:
        return Tables(
            self.orders, self.prior, self.train, self.products, self.aisles, self.departments
        )
