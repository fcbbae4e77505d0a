"""The batch jobs: feature tables, trained package, nightly lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators import features as X
from cartloom.operators import models as M
from cartloom.operators import recommend as R
from cartloom.operators.joins import history_of
from cartloom.operators.profile import require_first_order_quality
from cartloom.operators.sampling import sample_users
from cartloom.sources.package import Package, load_package, save_package
from cartloom.sources.tables import Tables, write_csv

FEATURE_TABLES = (
    "user_features",
    "product_features",
    "user_product_features",
    "final_features_train",
)


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as parquet and read back, so later steps do not compute it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def feature_batch(tables: Tables, out: str, work: str, fmt: str = "parquet") -> None:
    """Check the orders, then write the four feature tables under ``out``.

    ``work`` is a folder for the intermediate tables.
    """
    require_first_order_quality(tables.orders)
    past = tables.orders.filter(F.col("eval_set") == "prior")
    totals = _written(X.pair_totals(past, tables.prior), f"{work}/pair_totals")
    by_product = _written(X.product_totals(totals), f"{work}/product_totals")
    by_product = _written(
        X.product_features_ext(
            by_product, tables.products, tables.departments, tables.aisles
        ),
        f"{work}/product_features",
    )
    results = (
        X.user_features_ext(past, totals),
        by_product,
        X.interaction_features_ext(past, totals),
        X.training_matrix(tables.orders, totals, tables.train, by_product),
    )
    for name, df in zip(FEATURE_TABLES, results, strict=True):
        _write(df, f"{out}/{name}", fmt)


def train_package(
    tables: Tables,
    path: str,
    n_users: int | None = None,
    rounds: int = 200,
    depth: int = 6,
    rate: float = 0.1,
) -> Package:
    """Fit the boosted model on real labels and save it with the tables scoring needs.

    ``n_users`` trains on a seeded sample of users; the package keeps all orders and
    lines either way, and its user and product features cover everybody.
    """
    orders, prior = tables.orders, tables.prior
    if n_users is not None:
        orders, prior = history_of(sample_users(orders, n_users), orders, prior)
    by_product = _written(X.product_features(tables.prior), f"{path}/work/product_features")
    matrix = _written(
        M.labelled_serving_matrix(orders, prior, tables.train, by_product), f"{path}/work/matrix"
    )
    model = M.fit(M.boosted(X.SERVING_FEATURES, rounds, depth, rate), matrix)
    save_package(
        Package(
            model=model,
            features=list(X.SERVING_FEATURES),
            user_features=X.user_features(tables.orders, tables.prior),
            product_features=by_product,
            orders=tables.orders,
            prior=tables.prior,
            products=tables.products,
        ),
        path,
    )
    return load_package(tables.orders.sparkSession, path)


def score_pairs(package: Package) -> DataFrame:
    """The model's probability for every past user×product pair."""
    matrix = X.serving_matrix(package.orders, package.prior, package.product_features)
    return M.predict(package.model, matrix).select(
        "user_id", "product_id", "reorder_probability"
    )


def write_ranked(package: Package, path: str) -> DataFrame:
    """All pairs ranked per user: the table that requests are answered from."""
    return _written(R.ranked_pairs(score_pairs(package)), path)


def nightly(
    package: Package, ranked: DataFrame, out: str, run_date: str, k: int = 10
) -> DataFrame:
    """Top-``k`` lists of all users, popular products for those without history.

    Writes the partition of one run date; running a date again replaces it.
    """
    spark: SparkSession = ranked.sparkSession
    users = package.orders.select("user_id").distinct()
    known = ranked.filter(F.col("rank") == 1).select("user_id")
    lists = R.recommend_routed(
        users, known, ranked, package.product_features, package.products, k
    )
    path = f"{out}/run_date={run_date}"
    lists.write.mode("overwrite").parquet(path)
    return spark.read.option("basePath", out).parquet(path)
