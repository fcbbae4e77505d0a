"""Ranking and classification quality, and segment error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.columns import ratio
from cartloom.functions.ranking import top_k

SCORE_BUCKETS = 512


def top_products(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Each user's ``k`` best products: score descending, then product id."""
    return top_k(scores, "user_id", [F.desc(score), F.asc("product_id")], k)


def per_user_hits(y_true: DataFrame, y_prob: DataFrame, k: int = 10) -> DataFrame:
    """Hits, precision and recall per user with at least one actual reorder and a score.

    Precision divides by ``k`` even when a user has fewer candidates; recall divides by
    the number of reordered rows. A product counts as one hit however often it occurs.
    """
    actual = y_true.filter(F.col("reordered") == 1).select("user_id", "product_id")
    counts = actual.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_actual"))
    best = top_products(y_prob.select("user_id", "product_id", "score"), k)
    picked = best.select("user_id", "product_id").distinct()
    hits = (
        picked.join(actual.distinct().withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left")
        .groupBy("user_id")
        .agg(F.count("hit").alias("hits"))
    )
    return hits.join(counts, "user_id").select(
        "user_id",
        "hits",
        "n_actual",
        ratio(F.col("hits"), F.lit(k)).alias("precision"),
        ratio("hits", "n_actual").alias("recall"),
    )


def precision_recall_at_k(y_true: DataFrame, y_prob: DataFrame, k: int = 10) -> DataFrame:
    """Macro-averaged precision and recall at ``k``; 0 and 0 without any such user."""
    return per_user_hits(y_true, y_prob, k).agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_k"),
        F.count(F.lit(1)).alias("n_users"),
    )


def accuracy(scored: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Share of rows whose class at ``cut`` equals the label."""
    predicted = (F.col(score) > cut).cast("int")
    return scored.agg(F.avg((predicted == F.col(label)).cast("int")).alias("accuracy"))


def confusion(scored: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """True/false positives and negatives with precision, recall and F1."""
    says = F.col(score) > cut
    is_one = F.col(label) == 1

    def n(condition, name):
        return F.count(F.when(condition, 1)).alias(name)

    counts = scored.agg(
        n(says & is_one, "tp"), n(says & ~is_one, "fp"), n(~says & is_one, "fn"), n(~says & ~is_one, "tn")
    )
    return counts.withColumns(
        {
            "precision": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
            "recall": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
            "f1": F.coalesce(
                ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)
            ),
        }
    )


def curve_points(scored: DataFrame, label: str, score: str, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Per distinct score: positives and negatives at it and strictly above it.

    Equal scores fold into one row first. Prefix sums over the distinct scores then run
    in two levels: buckets at approximate quantiles of the distinct scores, so each
    bucket holds about 1/``buckets`` of them wherever the scores crowd, totals of the at
    most ``buckets`` + 1 buckets summed in one small window, and a window per bucket.
    """
    is_one = F.col(label) == 1
    points = (
        scored.select(F.col(score).cast("double").alias("score"), is_one.cast("long").alias("one"))
        .groupBy("score")
        .agg(F.sum("one").alias("pos"), F.sum(1 - F.col("one")).alias("neg"))
    )
    probs = [i / buckets for i in range(1, buckets)]
    # one row of cuts, found when the plan runs
    cuts = points.agg(F.percentile_approx("score", probs, 20 * buckets).alias("q")).scalar()
    below = F.filter("cuts", lambda cut: cut <= F.col("score"))
    cut = points.withColumn("cuts", F.coalesce(cuts, F.array().cast("array<double>")))
    cut = cut.withColumn("bucket", F.size(below)).drop("cuts")
    higher = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy("bucket")
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select(
            "bucket",
            F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("p_before"),
            F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_before"),
        )
    )
    within = (
        Window.partitionBy("bucket")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return cut.join(F.broadcast(totals), "bucket").select(
        "score",
        "pos",
        "neg",
        (F.col("p_before") + F.coalesce(F.sum("pos").over(within), F.lit(0))).alias("pos_above"),
        (F.col("n_before") + F.coalesce(F.sum("neg").over(within), F.lit(0))).alias("neg_above"),
    )


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties at half; null with one class only."""
    below = F.sum(F.col("neg").cast("double") * (F.col("pos_above") + F.col("pos") / 2))
    return curve_points(scored, label, score).agg(
        F.try_divide(below, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias(
            "roc_auc"
        )
    )


def average_precision(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve as the step sum over distinct scores."""
    seen = F.col("pos_above") + F.col("pos")
    step = F.col("pos") * ratio(seen, seen + F.col("neg_above") + F.col("neg"))
    return curve_points(scored, label, score).agg(
        F.try_divide(F.sum(step), F.sum("pos").cast("double")).alias("average_precision")
    )


def _segment_means(df: DataFrame, low, names: tuple[str, str]) -> DataFrame:
    p = F.col("predicted_prob")
    return df.agg(
        F.avg(F.when(low, p)).alias(names[0]),
        F.avg(F.when(~low, p)).alias(names[1]),
        F.count(F.when(low, 1)).alias(f"n_{names[0]}"),
        F.count(F.when(~low, 1)).alias(f"n_{names[1]}"),
    )


def with_predictions(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Test rows with their predictions, by user and product."""
    return test.join(predictions, ["user_id", "product_id"])


def cold_user_error(merged: DataFrame, few: int = 5) -> DataFrame:
    """Mean predicted probability of users with up to ``few`` orders and of the others."""
    return _segment_means(merged, F.col("u_total_orders") <= few, ("cold_users", "regular_users"))


def rare_item_error(merged: DataFrame, rare: int = 50) -> DataFrame:
    """Mean predicted probability of products below ``rare`` purchases and of the others."""
    return _segment_means(merged, F.col("p_total_purchases") < rare, ("rare_items", "popular_items"))
