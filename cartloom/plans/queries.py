"""The registered queries: each runs one operator over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.requests import parse_requests
from cartloom.operators import evaluate as E
from cartloom.operators import features as X
from cartloom.operators import joins as J
from cartloom.operators import models as M
from cartloom.operators import profile as P
from cartloom.operators import recommend as R
from cartloom.operators import sampling as S
from cartloom.operators import text as TX
from cartloom.operators.boosting import fit_newton, predict_newton
from cartloom.operators.logistic import INTERCEPT, fit_logistic
from cartloom.operators.svd import checks, truncated_svd
from cartloom.plans.data import MODELS, Data
from cartloom.schemas import ROW_ORDER
from cartloom.sources.package import PARTS, Package, load_package, save_package
from cartloom.sources.stage import scratch_path
from cartloom.sources.star import map_orders
from cartloom.sources.tables import load_all, pick, read_csv, write_csv
from cartloom.streaming.scoring import read_requests, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RARE_PURCHASES = 300
#: What a fit that has learned anything reaches; chance is 0.5.
LEARNED_AUC = 0.6


def query(build: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    return build


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums of doubles, whose last digits depend on the order of addition."""
    names = columns or [f.name for f in df.schema.fields if f.dataType == T.DoubleType()]
    return df.withColumns({c: F.round(c, digits) for c in names})


def _asked(d: Data) -> DataFrame:
    """All customers, each third one asking under an id without history."""
    key = F.col("c_custkey")
    return d.raw("customer").select(
        F.when(key % 3 == 0, key + 1_000_000_000).otherwise(key).alias("user_id")
    )


# --- scans, sinks, filters -------------------------------------------------------


@query
def scan_select_limit(d: Data) -> DataFrame:
    return pick(d.orders, ["order_id", "user_id", "order_number"], 1000, ROW_ORDER["orders"])


@query
def table_shapes(d: Data) -> DataFrame:
    return P.table_shapes(d.tables.named())


@query
def sink_roundtrip(d: Data) -> DataFrame:
    """Values and columns of the four feature tables after writing and reading CSV."""
    path = scratch_path(d.spark, "features_csv")
    tables = {
        "user_features": X.user_features_ext(d.prior_orders, d.pair_totals),
        "product_features": d.product_features_ext,
        "user_product_features": X.interaction_features_ext(d.prior_orders, d.pair_totals),
        "final_features_train": d.training_matrix,
    }
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")
    return _sums({n: read_csv(d.spark, f"{path}/{n}", df.schema) for n, df in tables.items()})


def _sums(tables: dict[str, DataFrame]) -> DataFrame:
    """Of each column of each table: rows, values present, and the sum of its numbers or of the
    lengths of its texts. Two columns that change places show."""
    found = []
    for name, df in tables.items():
        columns = []
        for field in df.schema:
            number = F.col(field.name) if isinstance(field.dataType, T.NumericType) else F.length(field.name)
            total = F.round(F.coalesce(F.sum(number.cast("double")), F.lit(0.0)), 3)
            of_column = (F.lit(field.name).alias("column_name"), F.count(field.name).alias("n_values"), total.alias("total"))
            columns.append(F.struct(*of_column))
        sums = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.array(*columns).alias("columns"))
        found.append(sums.select("table_name", "n_rows", F.inline("columns")))
    return reduce(DataFrame.unionByName, found)


@query
def csv_load_all(d: Data) -> DataFrame:
    """The six tables written as CSV with their columns in reverse, loaded by the CSV reader."""
    root = scratch_path(d.spark, "six_tables")
    for name, df in d.tables.named().items():
        write_csv(df.select(*reversed(df.columns)), f"{root}/{name}.csv")
    return _sums(load_all(d.spark, root).named())


@query
def sample_user_ids(d: Data) -> DataFrame:
    return S.known_user_ids(d.orders)


@query
def split_eval_set(d: Data) -> DataFrame:
    """The orders of all three sets, each with the set it was split into."""
    parts = S.split_by_eval_set(d.orders)
    return reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(n)) for n, df in parts.items()])


@query
def missing_report(d: Data) -> DataFrame:
    return P.missing_report(
        {"orders": d.orders, "order_products_train": d.train, "products": d.products}
    )


@query
def quality_first_order(d: Data) -> DataFrame:
    return P.first_order_quality(d.orders)


@query
def orders_first_flag(d: Data) -> DataFrame:
    return X.first_order_flags(d.orders)


# --- joins -----------------------------------------------------------------------


@query
def join_prior_orders(d: Data) -> DataFrame:
    return J.order_history(d.prior_orders, d.prior)


@query
def join_line_department(d: Data) -> DataFrame:
    return J.lines_with_department(d.train, d.products, d.departments)


@query
def semi_sampled_users(d: Data) -> DataFrame:
    """Orders and lines of up to 1500 users, counted per user."""
    orders, lines = J.history_of(S.sample_users(d.orders, 1500), d.orders, d.prior)
    of_order = lines.groupBy("order_id").agg(F.count("*").alias("n"))
    return orders.join(of_order, "order_id", "left").groupBy("user_id").agg(
        F.count("*").alias("n_orders"),
        F.sum("order_number").alias("sum_order_number"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
    )


@query
def join_line_department_salted(d: Data) -> DataFrame:
    """The same join by the way of a dimension that is too large to broadcast."""
    return J.lines_with_department(d.train, d.products, d.departments, max_rows=0)


@query
def orders_in_slices(d: Data) -> DataFrame:
    """Orders numbered by the way of users with very many of them."""
    return map_orders(d.raw("orders"), group_rows=3)


@query
def candidates(d: Data) -> DataFrame:
    return X.candidates(d.pair_totals, d.train_orders)


@query
def cold_users_anti(d: Data) -> DataFrame:
    return J.users_without_history(_asked(d), d.orders, d.prior)


# --- profiling -------------------------------------------------------------------


@query
def overview_counts(d: Data) -> DataFrame:
    return P.overview(d.orders)


@query
def target_distribution(d: Data) -> DataFrame:
    return P.target_distribution(d.train)


@query
def orders_per_user_stats(d: Data) -> DataFrame:
    return P.orders_per_user_stats(d.prior_orders)


@query
def orders_by_dow(d: Data) -> DataFrame:
    return P.orders_by_dow(d.orders)


@query
def orders_by_hour(d: Data) -> DataFrame:
    return P.orders_by_hour(d.orders)


@query
def order_gap_stats(d: Data) -> DataFrame:
    return P.order_gap_stats(d.prior_orders)


@query
def orders_by_gap(d: Data) -> DataFrame:
    return P.orders_by_gap(d.orders)


@query
def basket_size_stats(d: Data) -> DataFrame:
    return P.basket_size_stats(d.train)


@query
def basket_size_hist(d: Data) -> DataFrame:
    return rounded(P.basket_size_hist(d.train))


@query
def reorder_by_cart_pos(d: Data) -> DataFrame:
    return P.reorder_by_cart_position(d.train)


@query
def reorder_at_cart_pos(d: Data) -> DataFrame:
    return P.reorder_at_positions(d.train)


def _departments(d: Data) -> DataFrame:
    return P.department_totals(d.train, d.products, d.departments)


@query
def department_volume(d: Data) -> DataFrame:
    return P.department_volume(_departments(d))


@query
def department_reorder(d: Data) -> DataFrame:
    return P.department_reorder(_departments(d))


@query
def department_top5(d: Data) -> DataFrame:
    return P.department_volume(_departments(d), 5)


@query
def correlation_matrix(d: Data) -> DataFrame:
    product = d.product_features_ext.drop("aisle_id", "department_id")
    engineered = {
        "user_feat": X.user_features_ext(d.prior_orders, d.pair_totals),
        "prod_feat": product,
        "up_feat": X.interaction_features_ext(d.prior_orders, d.pair_totals),
        "final_df": d.training_matrix,
    }
    return rounded(P.correlations(d.tables.named() | engineered))


@query
def describe_table(d: Data) -> DataFrame:
    return rounded(P.describe(d.tables.named()))


def _engineered(d: Data) -> dict[str, DataFrame]:
    return {
        "orders": X.first_order_flags(d.orders),
        "user_feat": X.user_features_ext(d.prior_orders, d.pair_totals),
        "prod_feat": d.product_features_ext,
        "up_feat": X.interaction_features_ext(d.prior_orders, d.pair_totals),
    }


@query
def feature_catalogue(d: Data) -> DataFrame:
    return rounded(P.feature_catalogue(_engineered(d)))


@query
def feature_catalogue_counts(d: Data) -> DataFrame:
    """Features present, by method and by the table they belong to."""
    full = P.feature_catalogue(_engineered(d)).filter(F.col("n_present") > 0)
    counts = [
        P.catalogue_counts(full, by).select(F.lit(by).alias("counted_by"), F.col(by).alias("value"), "n_features")
        for by in ("method", "table_name")
    ]
    return counts[0].unionByName(counts[1])


@query
def dept_aisle_rates(d: Data) -> DataFrame:
    levels = [
        X.group_rates(d.product_features_ext, level).select(
            F.lit(level).alias("level"), F.col(level).alias("name"), "avg_reorder_rate"
        )
        for level in ("department", "aisle")
    ]
    return rounded(levels[0].unionByName(levels[1]))


# --- features --------------------------------------------------------------------


@query
def user_features(d: Data) -> DataFrame:
    return X.user_features(d.orders, d.prior)


@query
def user_features_ext(d: Data) -> DataFrame:
    return rounded(
        X.user_features_ext(d.prior_orders, d.pair_totals),
        "user_std_days_between",
        "user_std_order_hour",
    )


@query
def product_features(d: Data) -> DataFrame:
    return X.product_features(d.prior)


_PRODUCT_DOUBLES = ("product_std_cart_pos", "dept_avg_reorder_rate", "aisle_avg_reorder_rate")


@query
def product_features_ext(d: Data) -> DataFrame:
    return rounded(
        X.product_features_ext(d.product_totals, d.products, d.departments, d.star.aisles),
        *_PRODUCT_DOUBLES,
    )


@query
def interaction_features(d: Data) -> DataFrame:
    return X.interaction_features(d.orders, d.prior)


@query
def interaction_features_ext(d: Data) -> DataFrame:
    return X.interaction_features_ext(d.prior_orders, d.pair_totals)


_MATRIX_DOUBLES = (
    "user_std_days_between",
    "user_std_order_hour",
    "dept_avg_reorder_rate",
    "aisle_avg_reorder_rate",
)


@query
def feature_matrix(d: Data) -> DataFrame:
    return rounded(
        X.feature_matrix(d.prior_orders, d.pair_totals, d.product_features_ext), *_MATRIX_DOUBLES
    )


@query
def training_matrix(d: Data) -> DataFrame:
    return rounded(d.build_training_matrix(), *_MATRIX_DOUBLES)


@query
def label_balance(d: Data) -> DataFrame:
    return X.label_balance(d.build_training_matrix())


@query
def serving_matrix(d: Data) -> DataFrame:
    return X.serving_matrix(d.orders, d.prior, d.product_features)


def _parts(d: Data) -> DataFrame:
    return d.raw("part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("product_name"),
    )


@query
def text_tfidf(d: Data) -> DataFrame:
    return rounded(TX.tfidf(_parts(d)))


@query
def text_tfidf_documents(d: Data) -> DataFrame:
    return rounded(TX.tfidf(d.raw("documents"), "doc_id", "text"))


@query
def text_svd(d: Data) -> DataFrame:
    return TX.text_features(_parts(d))


@query
def text_svd_documents(d: Data) -> DataFrame:
    return TX.text_features(d.raw("documents"), "doc_id", "text")


@query
def text_svd_checks(d: Data) -> DataFrame:
    """Orthogonality, lengths, the singular equation and the residual of both decompositions."""
    both = {"product_name": (_parts(d), "product_id", "product_name"), "text": (d.raw("documents"), "doc_id", "text")}
    found = []
    for name, (df, key, text) in both.items():
        rows, vocabulary = TX.tfidf_rows(df, key, text)
        held = checks(rows, key, truncated_svd(rows, key, 10, len(vocabulary.terms)))
        found.append(rounded(held.select(F.lit(name).alias("source"), "*"), "squared_norm"))
    return reduce(DataFrame.unionByName, found)


# --- ranking, sampling -----------------------------------------------------------


@query
def top_k_per_user(d: Data) -> DataFrame:
    return E.top_products(d.scored, 10, "reorder_probability")


@query
def temporal_split(d: Data) -> DataFrame:
    return S.temporal_split(d.orders).select("order_id", "user_id", "order_number", "split")


@query
def sample_users(d: Data) -> DataFrame:
    return S.sample_users(d.orders)


@query
def hash_split(d: Data) -> DataFrame:
    return S.hash_split(d.pair_totals.select("user_id", "product_id"))


# --- models ----------------------------------------------------------------------


@query
def model_logistic(d: Data) -> DataFrame:
    return d.model_scores("logistic")


@query
def model_forest(d: Data) -> DataFrame:
    return d.model_scores("forest")


@query
def model_gbt(d: Data) -> DataFrame:
    return d.model_scores("boosted")


@query
def model_comparison(d: Data) -> DataFrame:
    return M.compare_scores({name: d.model_scores(name) for name in MODELS})


@query
def model_checks(d: Data) -> DataFrame:
    """What holds of every model's scores whatever the fit: the test pairs and labels are all
    there, probabilities lie in [0, 1], and the class is the more probable one."""
    p = F.col("reorder_probability")
    agrees = F.col("prediction") == (p > 0.5).cast("int")
    checks = [
        d.model_scores(name).agg(
            F.lit(name).alias("model"),
            F.count("*").alias("n_rows"),
            F.sum("user_id").alias("sum_user_id"),
            F.sum("product_id").alias("sum_product_id"),
            F.sum("reordered").alias("n_positive"),
            F.count_if(p.between(0.0, 1.0)).alias("n_in_range"),
            F.count_if(agrees | (F.abs(p - 0.5) < 1e-9)).alias("n_consistent"),
        )
        for name in MODELS
    ]
    return reduce(DataFrame.unionByName, checks)


@query
def model_newton(d: Data) -> DataFrame:
    return d.newton_scores


@query
def newton_trees(d: Data) -> DataFrame:
    """Two small trees over all labelled pairs: every split, gain and leaf."""
    found = fit_newton(d.model_matrix, X.SERVING_FEATURES, rounds=2, depth=3, bins=16)
    return rounded(rounded(found.nodes(d.spark), "cut", "weight"), "gain", digits=3)


@query
def model_learns(d: Data) -> DataFrame:
    """What a constant or shuffled model fails, over all labelled pairs: reordered ones rank clearly
    above the others, and scores differ."""
    scores = {name: d.pair_scores(name) for name in (*MODELS, "newton")}
    checks = []
    for name, scored in scores.items():
        counted = scored.agg(
            F.count("*").alias("n_rows"),
            (F.count_distinct("reorder_probability") > 20).alias("varies"),
        )
        better = (F.col("roc_auc") > LEARNED_AUC).alias("ranks_better_than_chance")
        named = F.lit(name).alias("model")
        area = E.roc_auc(scored, "reordered", "reorder_probability").select(named, "roc_auc")
        both = area.join(counted.select(named, "*"), "model")
        checks.append(both.select("model", "n_rows", better, "varies"))
    return reduce(DataFrame.unionByName, checks)


@query
def logistic_certificate(d: Data) -> DataFrame:
    """That the Newton fit on the training pairs is the optimum: per term its mean and deviation, the
    gradient (zero), whether the objective curves upwards, and whether Spark's coefficient is the same."""
    train = d.split_matrix.filter(F.col("split") == "train")
    found = fit_logistic(train, X.SERVING_FEATURES)
    spark_fit = d.model("logistic").stages[-1]
    others = (*spark_fit.coefficients.toArray().tolist(), float(spark_fit.intercept))
    terms = [(t, float(w)) for t, w in zip((*X.SERVING_FEATURES, INTERCEPT), others)]
    table = found.table(d.spark).join(d.spark.createDataFrame(terms, "term string, other double"), "term")
    near = F.abs(F.col("weight") - F.col("other")) <= 1e-3 * (1 + F.abs("weight"))
    return table.select(
        "term",
        "n_rows",
        F.round("mean", 6).alias("mean"),
        F.round("deviation", 6).alias("deviation"),
        (F.round(F.abs("gradient"), 7)).alias("gradient"),
        (F.col("curvature") > 0).alias("curves_upwards"),
        near.alias("agrees"),
    )


@query
def align_features(d: Data) -> DataFrame:
    """Model input from rows in which one feature is absent: it counts as 0."""
    found = d.model_matrix.drop("p_avg_cart_position").withColumnRenamed("reordered", "label")
    return M.align(found, X.SERVING_FEATURES, ["user_id", "product_id"])


@query
def package_roundtrip(d: Data) -> DataFrame:
    """Contents of every table of a package after saving and loading it, and the test pairs
    that the loaded boosted model scores as before."""
    path = scratch_path(d.spark, "package")
    model = d.model("boosted")
    saved = Package(
        model=model,
        features=M.model_features(model),
        user_features=X.user_features(d.orders, d.prior),
        product_features=d.product_features,
        orders=d.orders,
        prior=d.prior,
        products=d.products,
    )
    save_package(saved, path)
    loaded = load_package(d.spark, path)
    contents = _sums({part: getattr(loaded, part) for part in PARTS})
    test = d.split_matrix.filter(F.col("split") == "test")
    keys = ["user_id", "product_id"]
    again = M.predict(loaded.model, test, keys).withColumnRenamed("reorder_probability", "again")
    both = d.model_scores("boosted").join(again.select(*keys, "again"), keys)
    same = both.filter(F.col("again") == F.col("reorder_probability"))
    zero = F.lit(0).cast("long")
    scores = same.agg(
        F.lit("scores").alias("table_name"),
        F.count("*").alias("n_rows"),
        F.lit("features").alias("column_name"),
        zero.alias("n_values"),
        F.lit(float(len(loaded.features))).alias("total"),
    )
    return contents.unionByName(scores)


# --- recommendation --------------------------------------------------------------


@query
def recommend_personal(d: Data) -> DataFrame:
    return R.recommend_personal(d.scored, d.products, 10, 0.1)


@query
def recommend_cold(d: Data) -> DataFrame:
    return R.recommend_cold(d.product_features, d.products, 10, 0.05)


def _routed(d: Data, k: int, threshold: float) -> DataFrame:
    known = R.users_with_history(d.orders, d.prior)
    return R.recommend_routed(
        _asked(d), known, d.scored, d.product_features, d.products, k, threshold
    )


@query
def recommend_routed(d: Data) -> DataFrame:
    return _routed(d, 5, 0.2)


@query
def recommend_summary(d: Data) -> DataFrame:
    return R.summary(_routed(d, 10, 0.0))


@query
def batch_top10(d: Data) -> DataFrame:
    everyone = d.raw("customer").select(F.col("c_custkey").alias("user_id"))
    known = R.users_with_history(d.orders, d.prior)
    return R.recommend_routed(
        everyone, known, d.scored, d.product_features, d.products, 10, 0.0
    )


@query
def parse_requests_json(d: Data) -> DataFrame:
    parsed = parse_requests(d.requests)
    return parsed.select("request_id", "user_id", "top_k", "threshold", "error")


QUERIES["parse_requests"] = QUERIES.pop("parse_requests_json")


@query
def score_requests(d: Data) -> DataFrame:
    return R.answer_rows(d.parsed_requests, d.ranked, d.product_features, d.products)


RESPONSE = (
    "user_id long, mode string, error string, predictions array<struct<"
    "product_id: long, product_name: string, reorder_probability: double>>"
)


@query
def nightly_increments(d: Data) -> DataFrame:
    """The ranking after a first load and three nights of new orders."""
    return d.ranked_store.read("ranked").select("user_id", "product_id", "reorder_probability", "rank")


@query
def score_requests_store(d: Data) -> DataFrame:
    """``score_requests`` from the parts of the store that hold the users asked for."""
    asked = d.parsed_requests.select("user_id")
    ranked = d.ranked_store.lookup(asked)
    return R.answer_rows(d.parsed_requests, ranked, d.product_features, d.products)


@query
def score_requests_json(d: Data) -> DataFrame:
    responses = R.score_requests(d.requests, d.ranked, d.product_features, d.products)
    return _unpacked(responses, "request_id")


def _unpacked(responses: DataFrame, *keep: str) -> DataFrame:
    r = F.from_json("response", RESPONSE)
    return responses.select(*keep, r.alias("r")).select(
        *keep, "r.user_id", "r.mode", "r.error", F.posexplode_outer("r.predictions").alias("pos", "p")
    ).select(*keep, "user_id", "mode", "error", (F.col("pos") + 1).alias("rank"), "p.*")


@query
def score_requests_stream(d: Data) -> DataFrame:
    run = f"{scratch_path(d.spark, 'request_stream')}/{d.spark.sql('select uuid()').first()[0]}"
    d.requests.select("raw").write.text(f"{run}/in")
    score_stream(
        read_requests(d.spark, f"{run}/in"),
        d.ranked,
        d.product_features,
        d.products,
        f"{run}/out",
        f"{run}/checkpoint",
    ).awaitTermination()
    return _unpacked(d.spark.read.parquet(f"{run}/out"))


# --- evaluation ------------------------------------------------------------------


@query
def precision_recall_at_k(d: Data) -> DataFrame:
    return rounded(E.precision_recall_at_k(d.labelled_scores, d.labelled_scores))


@query
def per_user_hits(d: Data) -> DataFrame:
    return E.per_user_hits(d.labelled_scores, d.labelled_scores)


@query
def accuracy(d: Data) -> DataFrame:
    return E.accuracy(d.labelled_scores, "reordered", "score")


@query
def roc_auc(d: Data) -> DataFrame:
    return rounded(E.roc_auc(d.labelled_scores, "reordered", "score"))


@query
def f1_pr(d: Data) -> DataFrame:
    return E.confusion(d.labelled_scores, "reordered", "score")


@query
def average_precision(d: Data) -> DataFrame:
    return rounded(E.average_precision(d.labelled_scores, "reordered", "score"))


def _merged(d: Data) -> DataFrame:
    test = X.serving_matrix(d.orders, d.prior, d.product_features).select(
        "user_id", "product_id", "u_total_orders", "p_total_purchases"
    )
    predictions = d.labelled_scores.select(
        "user_id",
        "product_id",
        F.col("reordered").alias("actual"),
        F.col("score").alias("predicted_prob"),
    )
    return E.with_predictions(test, predictions)


@query
def error_cold_users(d: Data) -> DataFrame:
    return rounded(E.cold_user_error(_merged(d)))


@query
def error_rare_items(d: Data) -> DataFrame:
    return rounded(E.rare_item_error(_merged(d), RARE_PURCHASES))


@query
def error_rare_items_default(d: Data) -> DataFrame:
    """With the operator's own bound, below which small tables have no product."""
    return rounded(E.rare_item_error(_merged(d)))
