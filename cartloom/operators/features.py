"""User, product and user×product features, training and serving matrices.

Two families, as in the modelling notebook (``*_ext``, prior orders only) and in the
scoring pipeline (all orders). Every aggregate is decomposable, so Spark combines it in
the map tasks and a user or product with a great share of the rows costs one partial
row per task. User and product statistics roll up from the user×product totals, the
finest grain needed, which also turns distinct counts into plain counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions.columns import ratio, same_within, std_from_sums
from cartloom.operators.joins import attach, catalogue

USER_EXT = (
    "user_total_orders",
    "user_avg_days_between",
    "user_std_days_between",
    "user_min_days_between",
    "user_max_days_between",
    "user_avg_order_hour",
    "user_std_order_hour",
    "user_total_products",
    "user_unique_products",
    "user_total_reorders",
    "user_reorder_rate",
    "user_avg_basket_size",
)
PAIR_EXT = (
    "up_times_ordered",
    "up_reorder_count",
    "up_avg_cart_position",
    "up_first_order_number",
    "up_last_order_number",
    "up_reorder_rate",
    "up_orders_span",
    "up_buy_frequency",
    "up_orders_since_last",
    "up_recency_score",
)
PRODUCT_KEY = (
    "product_total_orders",
    "product_reorder_rate",
    "product_avg_cart_pos",
    "product_unique_users",
    "dept_avg_reorder_rate",
    "aisle_avg_reorder_rate",
)
SERVING_FEATURES = (
    "up_total_purchases",
    "up_first_order_num",
    "up_last_order_num",
    "up_order_rate",
    "up_order_rate_since_first_play",
    "u_total_orders",
    "u_avg_basket_size",
    "u_reorder_ratio",
    "u_avg_days_between_orders",
    "p_total_purchases",
    "p_reorder_prob",
    "p_avg_cart_position",
)


def first_order_flags(orders: DataFrame) -> DataFrame:
    """Orders with the missing gap filled with 0 and an ``is_first_order`` flag."""
    return orders.withColumns(
        {
            "days_since_prior_order": F.coalesce("days_since_prior_order", F.lit(0.0)),
            "is_first_order": (F.col("order_number") == 1).cast("int"),
        }
    )


# --- pipeline family -------------------------------------------------------------


def user_features(orders: DataFrame, prior: DataFrame) -> DataFrame:
    """Orders, basket size, reorder share and gap per user over all orders."""
    baskets = prior.groupBy("order_id").agg(
        F.max("add_to_cart_order").alias("basket"),
        F.count("reordered").alias("lines"),
        F.sum("reordered").alias("reorders"),
    )
    return (
        orders.select("order_id", "user_id", "order_number", "days_since_prior_order")
        .join(baskets, "order_id", "left")
        .groupBy("user_id")
        .agg(
            F.max("order_number").alias("u_total_orders"),
            F.avg("basket").alias("u_avg_basket_size"),
            ratio(F.sum("reorders"), F.sum("lines")).alias("u_reorder_ratio"),
            F.avg("days_since_prior_order").alias("u_avg_days_between_orders"),
        )
    )


def product_features(prior: DataFrame) -> DataFrame:
    """Purchases, reorder share and cart position per product."""
    return prior.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("p_total_purchases"),
        F.avg("reordered").alias("p_reorder_prob"),
        F.avg("add_to_cart_order").alias("p_avg_cart_position"),
    )


def _pair_counts(orders: DataFrame, prior: DataFrame) -> DataFrame:
    return (
        prior.select("order_id", "product_id")
        .join(orders.select("order_id", "user_id", "order_number"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("up_total_purchases"),
            F.min("order_number").alias("up_first_order_num"),
            F.max("order_number").alias("up_last_order_num"),
        )
    )


def _counts_of(totals: DataFrame) -> DataFrame:
    return totals.select(
        "user_id",
        "product_id",
        F.col("n").alias("up_total_purchases"),
        F.col("first_number").alias("up_first_order_num"),
        F.col("last_number").alias("up_last_order_num"),
    )


def _to_buckets(users: DataFrame, buckets: int) -> DataFrame:
    """Dealt as the pairs are: of two sides that lie by user, Spark moves the one in fewer parts."""
    return users.repartition(buckets, "user_id") if buckets else users


def _pair_rates(pairs: DataFrame) -> DataFrame:
    possible = F.col("u_total_orders") - F.col("up_first_order_num") + 1
    return pairs.withColumns(
        {
            "up_order_rate": ratio(F.col("up_total_purchases"), possible),
            "up_order_rate_since_first_play": ratio("up_total_purchases", "u_total_orders"),
        }
    )


def interaction_features(orders: DataFrame, prior: DataFrame) -> DataFrame:
    """Purchases, first and last order and order rates per user×product.

    ``up_order_rate`` counts the orders since the first purchase,
    ``up_order_rate_since_first_play`` all orders of the user.
    """
    totals = orders.groupBy("user_id").agg(F.max("order_number").alias("u_total_orders"))
    pairs = _pair_counts(orders, prior).join(totals, "user_id")
    return _pair_rates(pairs).select("user_id", "product_id", *SERVING_FEATURES[:5])


def serving_matrix(
    orders: DataFrame, prior: DataFrame, by_product: DataFrame | None = None, totals: DataFrame | None = None, buckets: int = 0
) -> DataFrame:
    """One row per past user×product pair with the 12 model features, nulls as 0.

    ``by_product`` may pass staged ``product_features``, ``totals`` staged ``pair_totals`` of the same
    orders, in ``buckets`` by user; the pair rates use the user's order total from the same join that
    brings the user features.
    """
    by_product = product_features(prior) if by_product is None else by_product
    counts = _pair_counts(orders, prior) if totals is None else _counts_of(totals)
    pairs = _pair_rates(counts.join(_to_buckets(user_features(orders, prior), buckets), "user_id"))
    matrix = attach(pairs, by_product, "product_id", "left", spread=["user_id"])
    return matrix.na.fill(0, list(SERVING_FEATURES)).select(
        "user_id", "product_id", *SERVING_FEATURES
    )


# --- notebook family -------------------------------------------------------------


def pair_totals(prior_orders: DataFrame, prior: DataFrame) -> DataFrame:
    """Sums per user×product over the prior lines; stage it when used more than once."""
    cart = F.col("add_to_cart_order").cast("long")
    return (
        prior.join(prior_orders.select("order_id", "user_id", "order_number"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("reordered").alias("reorders"),
            F.sum(cart).alias("cart_sum"),
            F.sum(cart * cart).alias("cart_squares"),
            F.min("order_number").alias("first_number"),
            F.max("order_number").alias("last_number"),
        )
    )


def _with_recency(totals: DataFrame) -> DataFrame:
    """Derived user×product columns; needs ``user_max_order`` beside the totals."""
    span = F.col("last_number") - F.col("first_number")
    since = F.col("user_max_order") - F.col("last_number")
    return totals.withColumns(
        {
            "up_times_ordered": F.col("n"),
            "up_reorder_count": F.col("reorders"),
            "up_avg_cart_position": ratio("cart_sum", "n"),
            "up_first_order_number": F.col("first_number"),
            "up_last_order_number": F.col("last_number"),
            "up_reorder_rate": ratio("reorders", "n"),
            "up_orders_span": span,
            "up_buy_frequency": ratio(F.col("n"), span + 1),
            "up_orders_since_last": since,
            "up_recency_score": ratio(F.lit(1), since + 1),
        }
    )


def interaction_features_ext(prior_orders: DataFrame, totals: DataFrame) -> DataFrame:
    """Frequency, span and recency per user×product over prior orders."""
    last = prior_orders.groupBy("user_id").agg(F.max("order_number").alias("user_max_order"))
    return _with_recency(totals.join(last, "user_id", "left")).select(
        "user_id", "product_id", *PAIR_EXT[:8], "user_max_order", *PAIR_EXT[8:]
    )


def _user_features_ext(prior_orders: DataFrame, totals: DataFrame) -> DataFrame:
    gap, hour = F.col("days_since_prior_order"), F.col("order_hour_of_day")
    by_order = prior_orders.groupBy("user_id").agg(
        F.count("order_id").alias("user_total_orders"),
        F.avg(gap).alias("user_avg_days_between"),
        F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("user_std_days_between"),
        F.min(gap).alias("user_min_days_between"),
        F.max(gap).alias("user_max_days_between"),
        F.avg(hour).alias("user_avg_order_hour"),
        F.coalesce(F.stddev_samp(hour), F.lit(0.0)).alias("user_std_order_hour"),
        F.max("order_number").alias("user_max_order"),
    )
    by_line = totals.groupBy("user_id").agg(
        F.sum("n").alias("user_total_products"),
        F.count(F.lit(1)).alias("user_unique_products"),
        F.sum("reorders").alias("user_total_reorders"),
    )
    return by_order.join(by_line, "user_id", "left").withColumns(
        {
            "user_reorder_rate": ratio("user_total_reorders", "user_total_products"),
            "user_avg_basket_size": ratio("user_total_products", "user_total_orders"),
        }
    )


def user_features_ext(prior_orders: DataFrame, totals: DataFrame) -> DataFrame:
    """Gap, hour, volume and reorder behaviour per user over prior orders.

    ``user_avg_basket_size`` is products per order, as the feature is described; the
    original formula divides the product count by itself and is always 1.
    """
    return _user_features_ext(prior_orders, totals).select("user_id", *USER_EXT)


def product_totals(totals: DataFrame) -> DataFrame:
    """Volume, reorder and cart statistics per product, rolled up from the pairs.

    One row per product: stage it before ``product_features_ext``, which reads it for
    the products and again for both group rates.
    """
    return (
        totals.groupBy("product_id")
        .agg(
            F.sum("n").alias("product_total_orders"),
            F.sum("reorders").alias("r"),
            F.sum("cart_sum").alias("s"),
            F.sum(F.col("cart_squares").cast("double")).alias("q"),
            F.count(F.lit(1)).alias("product_unique_users"),
        )
        .select(
            "product_id",
            "product_total_orders",
            ratio("r", "product_total_orders").alias("product_reorder_rate"),
            ratio("s", "product_total_orders").alias("product_avg_cart_pos"),
            std_from_sums("product_total_orders", "s", "q").alias("product_std_cart_pos"),
            "product_unique_users",
        )
    )


def product_features_ext(
    by_product: DataFrame, products: DataFrame, departments: DataFrame, aisles: DataFrame
) -> DataFrame:
    """``product_totals`` with catalogue data and department and aisle rates."""
    by_product = by_product.join(
        catalogue(products, departments, aisles), "product_id", "left"
    )
    rated = by_product
    for level, name in (("department", "dept_avg_reorder_rate"), ("aisle", "aisle_avg_reorder_rate")):
        rates = group_rates(by_product, level).withColumnRenamed("avg_reorder_rate", name)
        rated = rated.join(rates, level, "left")
    return rated.select(
        "product_id",
        "product_total_orders",
        "product_reorder_rate",
        "product_avg_cart_pos",
        "product_std_cart_pos",
        "product_unique_users",
        "product_name",
        "aisle_id",
        "department_id",
        "department",
        "aisle",
        "dept_avg_reorder_rate",
        "aisle_avg_reorder_rate",
    )


def group_rates(by_product: DataFrame, level: str) -> DataFrame:
    """Unweighted mean of the product reorder rates within a department or aisle."""
    return (
        by_product.filter(F.col(level).isNotNull())
        .groupBy(level)
        .agg(F.avg("product_reorder_rate").alias("avg_reorder_rate"))
    )


def candidates(totals: DataFrame, train_orders: DataFrame) -> DataFrame:
    """Every past pair of the users that have a train order, with that order."""
    return totals.select("user_id", "product_id").join(
        train_orders.select("user_id", "order_id"), "user_id"
    )


def _attach_products(pairs: DataFrame, by_product: DataFrame) -> DataFrame:
    keys = by_product.select("product_id", *PRODUCT_KEY)
    return attach(pairs, keys, "product_id", "left", spread=["user_id"])


def feature_matrix(
    prior_orders: DataFrame, totals: DataFrame, by_product: DataFrame
) -> DataFrame:
    """Every past pair with its pair, user and product features.

    ``totals`` (``pair_totals``) and ``by_product`` (``product_features_ext``) should be
    staged tables.
    """
    users = _user_features_ext(prior_orders, totals)
    pairs = _with_recency(totals.join(users, "user_id", "left"))
    return _attach_products(pairs, by_product).select(
        "user_id", "product_id", *PAIR_EXT, *USER_EXT, *PRODUCT_KEY
    )


def training_matrix(
    orders: DataFrame,
    totals: DataFrame,
    train: DataFrame,
    by_product: DataFrame,
    buckets: int = 0,
) -> DataFrame:
    """Labelled matrix: candidates with pair, user and product features and the label.

    Inputs as for ``feature_matrix``, ``totals`` in ``buckets`` by user. The user features and the train order travel in one
    user-keyed table, and so do the labels, so pairs that lie by user are not moved;
    products are attached last without moving the pairs.
    """
    prior_orders = orders.filter(F.col("eval_set") == "prior")
    train_orders = orders.filter(F.col("eval_set") == "train")
    users = train_orders.select("user_id", "order_id").join(
        _user_features_ext(prior_orders, totals), "user_id", "left"
    )
    matrix = labelled(_with_recency(totals.join(_to_buckets(users, buckets), "user_id")), train_orders, train)
    return _attach_products(matrix, by_product).select(
        "user_id",
        "product_id",
        "order_id",
        *PAIR_EXT,
        *USER_EXT,
        *PRODUCT_KEY,
        "reordered",
    )


def labelled(pairs: DataFrame, train_orders: DataFrame, train: DataFrame) -> DataFrame:
    """``pairs`` (user, product and the user's train order) with ``reordered`` of that order's line of the
    product, 0 without one. The lines come to the pairs of their user, which stay where they are."""
    lines = train.select("order_id", "product_id", "reordered").join(train_orders.select("order_id", "user_id"), "order_id")
    lines = lines.select(
        F.col("user_id").alias("_user"), F.col("order_id").alias("_order"), F.col("product_id").alias("_product"), "reordered"
    )
    there = (F.col("user_id") == F.col("_user")) & same_within("product_id", "_product") & same_within("order_id", "_order")
    matched = pairs.join(lines, there, "left").drop("_user", "_order", "_product")
    return matched.withColumn("reordered", F.coalesce("reordered", F.lit(0)).cast("int"))


def label_balance(matrix: DataFrame) -> DataFrame:
    """Rows, positives, negatives and positive share of a labelled matrix."""
    label = F.col("reordered")
    return matrix.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(label).alias("n_positive"),
        F.sum((label == 0).cast("long")).alias("n_negative"),
        F.avg(label).alias("positive_rate"),
    )
