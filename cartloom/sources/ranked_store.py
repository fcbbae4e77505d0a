"""The nightly ranking as a table that is kept up to date from new orders only.

Three tables lie under one folder, each partitioned by ``part``, a hash of the user:

* ``pairs``: sums per user×product that merge by adding or by least and greatest (lines, reorders, cart
  positions, first and last order);
* ``users``: each user's highest order number;
* ``ranked``: each user's products by falling probability, with their rank.

``apply`` reads a batch of new orders and their lines, merges their sums into the parts that hold their
users, ranks the users of these parts again, and overwrites those parts alone. Other parts are neither read nor
written, so a night costs what its orders touch. Each row carries the last batch of its part: a batch that
was cut off half way is applied again only where it was not, and one that is complete not at all.

Rows are dealt once, by ranges of part and user as the files have them, before they are merged or ranked:
both need the rows of a user together, and ranges are then found in stored rows, not in computed ones.

``lookup`` reads the parts of the users asked for. Within a part, files are ranges of users, sorted by user and
with a Bloom filter, so a few requests open a few files and a few row groups in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.columns import ratio
from cartloom.operators.recommend import personal_order, ranked_pairs

PAIRS = (
    "user_id long, product_id long, n long, reorders long, cart_sum long, first_number int, last_number int, "
    "as_of int, part int"
)
USERS = "user_id long, total_orders int, as_of int, part int"
RANKED = "user_id long, product_id long, reorder_probability double, rank int, as_of int, part int"
#: How each sum of two states of a pair or a user merges.
MERGE = {
    "n": F.sum,
    "reorders": F.sum,
    "cart_sum": F.sum,
    "first_number": F.min,
    "last_number": F.max,
    "total_orders": F.max,
}


def order_rate() -> Column:
    """Purchases per order since the first one."""
    return ratio(F.col("n"), F.col("total_orders") - F.col("first_number") + 1)


class RankedStore:
    """The three tables under ``folder`` in ``parts`` parts (about a part per 128 MB of pairs).

    ``score`` is an expression over a pair's sums and its user's ``total_orders``; it must not
    look at other users or products, whose changes would not be seen.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64, score: Callable[[], Column] = order_rate):
        self.spark, self.folder, self.parts, self.score = spark, folder, parts, score

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(self.parts)).cast("int").alias("part")

    def read(self, name: str) -> DataFrame:
        """One of the three tables, empty before the first batch."""
        schema = T._parse_datatype_string({"pairs": PAIRS, "users": USERS, "ranked": RANKED}[name])
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def batches(self) -> list[int]:
        """The batches that are complete."""
        path = f"{self.folder}/batches"
        return sorted(r[0] for r in self.spark.read.parquet(path).collect()) if self._exists(path) else []

    def apply(self, batch: int, orders: DataFrame, lines: DataFrame) -> list[int]:
        """Take in new ``orders`` (user_id, order_id, order_number) and their ``lines`` (order_id, product_id,
        reordered, add_to_cart_order); the parts that were written. Batches are numbered upwards; a
        complete one is not applied again. Lines whose order is not in the batch do not count."""
        complete = self.batches()
        if batch in complete:
            return []
        if complete and batch < complete[-1]:
            raise ValueError(f"batch {batch} comes after batch {complete[-1]}")
        work = f"{self.folder}/work/{batch}"
        known = orders.filter(F.col("user_id").isNotNull())
        users = known.groupBy("user_id").agg(F.max("order_number").cast("int").alias("total_orders"))
        pairs = (
            lines.filter(F.col("product_id").isNotNull())
            .join(known.select("order_id", "user_id", "order_number"), "order_id")
            .groupBy("user_id", "product_id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.coalesce(F.sum(F.col("reordered").cast("long")), F.lit(0)).alias("reorders"),
                F.coalesce(F.sum(F.col("add_to_cart_order").cast("long")), F.lit(0)).alias("cart_sum"),
                F.min("order_number").cast("int").alias("first_number"),
                F.max("order_number").cast("int").alias("last_number"),
            )
        )
        users = self._written(users.select("*", self._part()), f"{work}/users")
        pairs = self._written(pairs.select("*", self._part()), f"{work}/pairs")
        touched = [r[0] for r in users.select("part").distinct().collect()]  # at most self.parts
        self._merge("pairs", pairs, ["user_id", "product_id"], batch, touched)
        self._merge("users", users, ["user_id"], batch, touched)
        self._rank(batch, touched)
        log = self.spark.createDataFrame([(batch,)], "batch int").coalesce(1)
        log.write.mode("append").parquet(f"{self.folder}/batches")
        return sorted(touched)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _open(self, name: str, batch: int, touched: list[int]) -> list[int]:
        """The touched parts of a table that lack the batch."""
        seen = self.read(name).filter(F.col("part").isin(touched)).groupBy("part").agg(F.max("as_of").alias("as_of"))
        done = {r["part"] for r in seen.filter(F.col("as_of") >= batch).collect()}
        return [p for p in touched if p not in done]

    def _merge(self, name: str, new: DataFrame, keys: list[str], batch: int, touched: list[int]) -> None:
        parts = self._open(name, batch, touched)
        if not parts:
            return
        inside = F.col("part").isin(parts)
        both = self._dealt(self.read(name).filter(inside).drop("as_of").unionByName(new.filter(inside)))
        sums = [MERGE[c](c).alias(c) for c in new.columns if c in MERGE]
        merged = both.groupBy("part", *keys).agg(*sums).withColumn("as_of", F.lit(batch))
        self._overwrite(name, merged.sortWithinPartitions("part", "user_id"))

    def _rank(self, batch: int, touched: list[int]) -> None:
        parts = self._open("ranked", batch, touched)
        if not parts:
            return
        inside = F.col("part").isin(parts)
        totals = self.read("users").filter(inside).drop("as_of")
        # a row per user, without a product, beside those of its pairs: brings the total without a join
        both = self._dealt(self.read("pairs").filter(inside).drop("as_of").unionByName(totals, allowMissingColumns=True))
        one = Window.partitionBy("part", "user_id")
        whole = both.select(
            *[c for c in both.columns if c != "total_orders"],
            F.max("total_orders").over(one).alias("total_orders"),
            F.max(F.col("product_id").isNull()).over(one).alias("is_known"),
        )
        pairs = whole.filter(F.col("product_id").isNotNull() & F.col("is_known"))
        ranked = ranked_pairs(pairs.withColumn("reorder_probability", self.score()), within=["part"])
        # the order in which they were ranked, so nothing is sorted again
        ranked = ranked.sortWithinPartitions("part", "user_id", *personal_order())
        self._overwrite("ranked", ranked.withColumn("as_of", F.lit(batch)))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Ranges of users within parts, about a part each; a user's rows stay together."""
        return rows.repartitionByRange(self.parts, "part", "user_id")

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace the parts that ``rows``, dealt and sorted by them, has: new files are made aside and moved
        in when all are there, so the old ones can be read until then."""
        columns = [f.name for f in T._parse_datatype_string({"pairs": PAIRS, "users": USERS, "ranked": RANKED}[name])]
        writer = rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if name == "ranked":  # the table that is looked up by user
            writer = writer.option("parquet.bloom.filter.enabled#user_id", "true")
            writer = writer.option("parquet.bloom.filter.expected.ndv#user_id", "100000")
        writer.partitionBy("part").parquet(f"{self.folder}/{name}")

    def lookup(self, requested: DataFrame) -> DataFrame:
        """The ranked pairs of the users in ``requested`` (user_id; repeats and nulls allowed), read from
        their parts alone. Users without pairs have no rows."""
        asked = requested.select(F.col("user_id").cast("long").alias("user_id")).filter("user_id IS NOT NULL").distinct()
        parts = [r[0] for r in asked.select(self._part()).distinct().collect()]  # at most self.parts
        ranked = self.read("ranked").filter(F.col("part").isin(parts)).drop("part", "as_of")
        if len(parts) < self.parts:  # few users: their ids reach the scan of the files
            few = [r[0] for r in asked.limit(FEW + 1).collect()]
            if len(few) <= FEW:
                return ranked.filter(F.col("user_id").isin(few))
        return ranked.join(asked, "user_id", "left_semi")


#: Users whose ids are put into the filter of the scan.
FEW = 100
