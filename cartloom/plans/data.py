"""Tables that several plans share, built and staged on first use."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.requests import parse_requests
from cartloom.operators import features as X
from cartloom.operators import models as M
from cartloom.operators.boosting import BoostedTrees, fit_newton, predict_newton
from cartloom.operators.models import labelled_serving_matrix
from cartloom.operators.recommend import ranked_pairs
from cartloom.operators.sampling import hash_split
from cartloom.sources import star
from cartloom.sources.ranked_store import RankedStore
from cartloom.sources.stage import LEAST_BUCKETS, bucket_count, input_bytes, staged, staged_folder, staged_model
from cartloom.sources.tables import Tables


#: Model by name, from its training rows.
MODELS: dict[str, Callable[[DataFrame], Pipeline]] = {
    "logistic": lambda train: M.logistic(X.SERVING_FEATURES, train.count()),
    "forest": lambda _: M.forest(X.SERVING_FEATURES),
    "boosted": lambda _: M.boosted(X.SERVING_FEATURES),
}

#: Rounds of the registered second-order model; a level of a round is a job of a sixth of a second.
NEWTON_ROUNDS = 50

#: Bytes of the customer file whose requests are one task: some 12,000 requests, about a second to parse.
REQUESTS_BYTES = 256 << 10


class Data:
    """Lazily built inputs of the plans over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.star = star.Star(spark, sf_dir)

    def _staged(self, name: str, build) -> DataFrame:
        return staged(self.spark, name, self.sf_dir, build)

    def raw(self, name: str) -> DataFrame:
        return star.raw(self.spark, self.sf_dir, name)

    @property
    def tables(self) -> Tables:
        return self.star.tables()

    @property
    def orders(self) -> DataFrame:
        return self.star.orders

    @property
    def prior(self) -> DataFrame:
        return self.star.prior

    @property
    def train(self) -> DataFrame:
        return self.star.train

    @property
    def products(self) -> DataFrame:
        return self.star.products

    @property
    def departments(self) -> DataFrame:
        return self.star.departments

    @property
    def prior_orders(self) -> DataFrame:
        return self.orders.filter(F.col("eval_set") == "prior")

    @property
    def train_orders(self) -> DataFrame:
        return self.orders.filter(F.col("eval_set") == "train")

    @cached_property
    def pair_totals(self) -> DataFrame:
        """Bucketed by user, which has at most one row per catalogue product here."""
        return staged(
            self.spark,
            "pair_totals",
            self.sf_dir,
            lambda: X.pair_totals(self.prior_orders, self.prior),
            bucket_by="user_id",
            size=self.star.size,
        )

    def _buckets(self) -> int:
        """Of the tables that are bucketed."""
        return bucket_count(self.star.size())

    @cached_property
    def product_totals(self) -> DataFrame:
        return self._staged("product_totals", lambda: X.product_totals(self.pair_totals))

    @cached_property
    def product_features_ext(self) -> DataFrame:
        return self._staged(
            "product_features_ext",
            lambda: X.product_features_ext(
                self.product_totals, self.products, self.departments, self.star.aisles
            ),
        )

    @cached_property
    def product_features(self) -> DataFrame:
        return self._staged("product_features", lambda: X.product_features(self.prior))

    @cached_property
    def training_matrix(self) -> DataFrame:
        return self._staged("training_matrix", self.build_training_matrix)

    def build_training_matrix(self) -> DataFrame:
        return X.training_matrix(
            self.orders, self.pair_totals, self.train, self.product_features_ext, self._buckets()
        )

    @property
    def scored(self) -> DataFrame:
        """Past pairs with a deterministic probability, ``up_order_rate``."""
        return X.interaction_features(self.orders, self.prior).select(
            "user_id", "product_id", F.col("up_order_rate").alias("reorder_probability")
        )

    @cached_property
    def ranked(self) -> DataFrame:
        return staged(
            self.spark,
            "ranked",
            self.sf_dir,
            lambda: ranked_pairs(self.scored),
            bucket_by="user_id",
            size=self.star.size,
        )

    @cached_property
    def parsed_requests(self) -> DataFrame:
        return self._staged("parsed_requests", lambda: parse_requests(self.requests))

    @cached_property
    def labelled_scores(self) -> DataFrame:
        """Labelled candidates with the deterministic probability."""
        labels = self.training_matrix.select("user_id", "product_id", "reordered")
        return self._staged(
            "labelled_scores",
            lambda: labels.join(self.scored, ["user_id", "product_id"]).withColumnRenamed(
                "reorder_probability", "score"
            ),
        )

    @cached_property
    def model_matrix(self) -> DataFrame:
        return self._staged(
            "model_matrix",
            lambda: labelled_serving_matrix(
                self.orders, self.prior, self.train, self.product_features, self.pair_totals, self._buckets()
            ),
        )

    def model(self, name: str) -> PipelineModel:
        """A model of ``MODELS`` at its full size, fitted once on the training pairs."""

        def fit() -> PipelineModel:
            train = self.split_matrix.filter(F.col("split") == "train")
            return M.fit(MODELS[name](train), train)

        return staged_model(self.spark, f"model_{name}", self.sf_dir, fit)

    @cached_property
    def split_matrix(self) -> DataFrame:
        return self._staged("split_matrix", lambda: hash_split(self.model_matrix))

    def model_scores(self, name: str) -> DataFrame:
        """The test pairs scored by a model, once for all queries."""
        return self._staged(
            f"scores_{name}",
            lambda: M.predict(
                self.model(name), self.split_matrix.filter(F.col("split") == "test").drop("split")
            ),
        )

    def pair_scores(self, name: str) -> DataFrame:
        """Label and score of all labelled pairs by a model of ``MODELS`` or ``newton``, written once: a
        curve reads them several times, and a score is a walk down all trees."""

        def build() -> DataFrame:
            pairs = self.split_matrix.drop("split")
            if name == "newton":
                return predict_newton(self.newton, pairs, ["reordered"])
            return M.predict(self.model(name), pairs, ["reordered"])

        return self._staged(f"pair_scores_{name}", build)

    @cached_property
    def newton(self) -> BoostedTrees:
        """Second-order boosted trees, fitted once on the training pairs."""
        path = staged_folder(
            self.spark,
            "model_newton",
            self.sf_dir,
            lambda path: fit_newton(
                self.split_matrix.filter(F.col("split") == "train"), X.SERVING_FEATURES, rounds=NEWTON_ROUNDS
            ).save(self.spark, path),
        )
        return BoostedTrees.load(self.spark, path)

    @cached_property
    def newton_scores(self) -> DataFrame:
        """The test pairs scored by ``newton``."""
        return self._staged(
            "scores_newton",
            lambda: predict_newton(
                self.newton, self.split_matrix.filter(F.col("split") == "test").drop("split")
            ),
        )

    @cached_property
    def ranked_store(self) -> RankedStore:
        """The ranking kept up from batches of orders: a user's first four orders, then the next
        three, three more, and the rest."""

        def write(path: str) -> None:
            number = F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.col("order_number") - 2) / 3)))
            for batch in range(4):
                RankedStore(self.spark, path).apply(batch, self.orders.filter(number == batch), self.prior)

        return RankedStore(self.spark, staged_folder(self.spark, "ranked_store", self.sf_dir, write))

    @property
    def requests(self) -> DataFrame:
        """One JSON request per customer, in every accepted and rejected form."""
        user = F.col("c_custkey").cast("string")
        k = (F.col("c_custkey") % 12 + 1).cast("string")
        t = F.concat(F.lit("0."), (F.col("c_custkey") % 5).cast("string"))
        far = (F.col("c_custkey") + 1_000_000_000).cast("string")

        def text(*parts) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        plain = text('{"user_id": ', user, ', "top_k": ', k, ', "threshold": ', t, "}")
        forms = [
            text('{"dataframe_records": [', plain, "]}"),
            plain,
            text('{"user_id": "', user, '", "top_k": "', k, '"}'),
            text('{"user_id": ', user, "}"),
            text('{"user_id": ', user),
            text('{"dataframe_records": []}'),
            text('{"top_k": ', k, "}"),
            text('{"user_id": ', far, ', "top_k": ', k, ', "threshold": ', t, "}"),
        ]
        form = F.col("c_custkey") % len(forms)
        raw = F.lit(None).cast("string")
        for i, value in enumerate(forms):
            raw = F.when(form == i, value).otherwise(raw)
        customers = self.raw("customer").select("c_custkey")
        # a file may be one row group and thus one task, and a request costs far more than its key
        tasks = max(LEAST_BUCKETS, -(-input_bytes(self.raw("customer")) // REQUESTS_BYTES))
        customers = customers.repartition(tasks, "c_custkey")
        return customers.select(F.col("c_custkey").alias("request_id"), raw.alias("raw"))
