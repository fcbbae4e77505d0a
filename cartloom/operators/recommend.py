"""Next-cart recommendation for all users, and answers to tables of requests.

The per-request loop becomes joins: pairs are scored and ranked once per user. Because a
ranking is by descending probability, "at least the threshold, then the first k" is the
prefix with rank <= k and probability >= threshold, so requests with different k and
threshold need no ranking of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.ranking import top_k
from cartloom.functions.requests import COLD_MODE, PERSONAL_MODE, parse_requests, response_json
from cartloom.operators.joins import BROADCAST_ROWS, attach, users_with_lines

UNKNOWN_PRODUCT = "Unknown Product"
PREDICTION = ("product_id", "product_name", "reorder_probability")


def with_names(items: DataFrame, products: DataFrame | None, spread: str) -> DataFrame:
    """Adds product_name; null for an unlisted product, a fixed text without a catalogue."""
    if products is None:
        return items.withColumn(
            "product_name", F.when(F.col("product_id").isNotNull(), UNKNOWN_PRODUCT)
        )
    names = products.select("product_id", "product_name")
    return attach(items, names, "product_id", "left", spread=[spread])


def personal_order() -> list[Column]:
    """Falling probability, then product id."""
    return [F.desc("reorder_probability"), F.asc("product_id")]


def _personal(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    kept = scored.select("user_id", "product_id", "reorder_probability").filter(
        F.col("reorder_probability") >= threshold
    )
    return top_k(kept, "user_id", personal_order(), k)


def _popular(by_product: DataFrame, k: int, threshold: float = float("-inf")) -> DataFrame:
    order = [F.desc("reorder_probability"), F.desc("p_total_purchases"), F.asc("product_id")]
    p = F.coalesce("p_reorder_prob", F.lit(0.0))
    best = (
        by_product.select("product_id", p.alias("reorder_probability"), "p_total_purchases")
        .filter(F.col("reorder_probability") >= threshold)
        .orderBy(*order)
        .limit(k)
    )
    # k rows: numbering them is a one-task job of that size
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "product_id",
        "reorder_probability",
    )


def recommend_personal(
    scored: DataFrame, products: DataFrame | None, k: int = 10, threshold: float = 0.0
) -> DataFrame:
    """Each user's ``k`` most probable past products at or above ``threshold``."""
    best = _personal(scored, k, threshold)
    return with_names(best, products, "user_id").select("user_id", "rank", *PREDICTION)


def recommend_cold(
    by_product: DataFrame, products: DataFrame | None, k: int = 10, threshold: float = 0.0
) -> DataFrame:
    """The ``k`` products with the highest reorder share, popular ones first on ties."""
    best = _popular(by_product, k, threshold)
    return with_names(best, products, "rank").select("rank", *PREDICTION)


def ranked_head(ranked: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Personal lists from pairs that are ranked already: a filter, no sort."""
    return ranked.filter((F.col("rank") <= k) & (F.col("reorder_probability") >= threshold))


def users_with_history(orders: DataFrame, prior: DataFrame, min_orders: int = 1) -> DataFrame:
    """Users that get a personal list: at least one line and ``min_orders`` orders."""
    known = users_with_lines(orders, prior)
    if min_orders <= 1:
        return known
    enough = (
        orders.groupBy("user_id")
        .agg(F.count("order_id").alias("n"))
        .filter(F.col("n") >= min_orders)
        .select("user_id")
    )
    return known.join(enough, "user_id", "left_semi")


def recommend_routed(
    requested: DataFrame,
    known: DataFrame,
    scored: DataFrame,
    by_product: DataFrame,
    products: DataFrame | None,
    k: int = 10,
    threshold: float = 0.0,
) -> DataFrame:
    """Personal lists for requested users in ``known``, the popular list for the others.

    ``scored`` pairs that have a ``rank`` within their user keep it.
    """
    asked = requested.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    warm = asked.join(known, "user_id", "left_semi")
    cold = asked.join(known, "user_id", "left_anti")
    own = scored.join(warm, "user_id", "left_semi")
    ranked = "rank" in scored.columns
    personal = ranked_head(own, k, threshold) if ranked else _personal(own, k, threshold)
    personal = personal.select("user_id", "product_id", "reorder_probability", "rank")
    slots = cold.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    fallback = attach(slots, _popular(by_product, k, threshold), "rank", spread=["user_id"])
    both = personal.withColumn("mode", F.lit(PERSONAL_MODE)).unionByName(
        fallback.withColumn("mode", F.lit(COLD_MODE))
    )
    return with_names(both, products, "user_id").select("user_id", "mode", "rank", *PREDICTION)


def summary(recommendations: DataFrame) -> DataFrame:
    """Suggested items, highest probability and mode per user."""
    is_cold = F.max((F.col("mode") == COLD_MODE).cast("int")) == 1
    return recommendations.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max("reorder_probability").alias("highest_probability"),
        F.when(is_cold, COLD_MODE).otherwise(PERSONAL_MODE).alias("mode"),
    )


def ranked_pairs(scored: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """All scored pairs with their rank within the user.

    ``within`` names columns that follow from the user; they are kept, and rows dealt by them and the user
    are not moved. A user has at most one pair per catalogue product, and ``row_number`` streams over
    the sorted partition, so no list is ever held as one value.
    """
    order = Window.partitionBy(*within, "user_id").orderBy(*personal_order())
    return scored.select(
        "user_id", "product_id", "reorder_probability", F.row_number().over(order).alias("rank"), *within
    )


def answer_rows(
    requests: DataFrame,
    ranked: DataFrame,
    by_product: DataFrame,
    products: DataFrame | None,
    request_id: str = "request_id",
) -> DataFrame:
    """Answers one row per prediction: request, user, mode, rank, product, probability.

    ``requests`` holds parsed requests. A request without predictions (or with an error)
    keeps one row with a null rank. ``ranked`` comes from ``ranked_pairs`` over the users
    with history; the row of rank 1 is always joined, as the sign of a known user.
    """
    valid = requests.filter(F.col("error").isNull()).select(
        request_id, "user_id", "top_k", "threshold"
    )
    asked = valid.agg(F.max("top_k").alias("deepest"), F.count(F.lit(1)).alias("n")).first()
    deepest = asked["deepest"] or 0
    # of the ranked table only what some request can show, and rank 1
    r = ranked.filter(F.col("rank") <= max(deepest, 1)).select(
        F.col("user_id").alias("known_user"), "rank", "product_id", "reorder_probability"
    )
    users = valid.select(F.col("user_id").alias("known_user")).distinct()
    users = F.broadcast(users) if asked["n"] <= BROADCAST_ROWS else users
    r = r.join(users, "known_user", "left_semi")
    passes = (F.col("rank") <= F.col("top_k")) & (F.col("reorder_probability") >= F.col("threshold"))
    joined = valid.join(
        r,
        (F.col("user_id") == F.col("known_user")) & ((F.col("rank") == 1) | passes),
        "left",
    )
    item = F.struct("rank", "product_id", "reorder_probability")
    depth = max(min(deepest, by_product.count()), 1)
    popular = _popular(by_product, depth).select(F.col("rank").alias("slot"), item.alias("popular"))
    is_known = F.col("known_user").isNotNull()
    # a cold request takes one slot per wanted product, and slot 1 even if it wants none
    wanted = F.greatest(F.least(F.col("top_k"), F.lit(depth)), F.lit(1)).cast("int")
    slots = F.sequence(F.lit(1), F.when(is_known, 1).otherwise(wanted))
    flat = joined.select(
        request_id,
        "user_id",
        "top_k",
        "threshold",
        is_known.alias("is_known"),
        F.when(is_known & passes, item).alias("own"),
        F.explode(slots).alias("slot"),
    )
    fits = (F.col("popular.rank") <= F.col("top_k")) & (
        F.col("popular.reorder_probability") >= F.col("threshold")
    )
    answered = attach(flat, popular, "slot", "left", spread=[request_id]).select(
        request_id,
        "user_id",
        F.when(F.col("is_known"), PERSONAL_MODE).otherwise(COLD_MODE).alias("mode"),
        F.when(F.col("is_known"), F.col("own")).otherwise(F.when(fits, F.col("popular"))).alias("p"),
        "slot",
        F.lit(None).cast("string").alias("error"),
    )
    failed = requests.filter(F.col("error").isNotNull()).select(
        request_id,
        F.lit(None).cast("long").alias("user_id"),
        F.lit(None).cast("string").alias("mode"),
        F.lit(None).cast(answered.schema["p"].dataType).alias("p"),
        F.lit(1).alias("slot"),
        "error",
    )
    # without predictions only the first slot stays, as the sign of an empty answer
    flat = (
        answered.unionByName(failed)
        .filter(F.col("p").isNotNull() | (F.col("slot") == 1))
        .select(request_id, "user_id", "mode", "p.*", "error")
    )
    return with_names(flat, products, request_id).select(
        request_id, "user_id", "mode", "rank", *PREDICTION, "error"
    )


def respond(answers: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One JSON response per request; its list holds at most top_k predictions."""
    items = F.sort_array(
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", *PREDICTION)))
    )
    return (
        answers.groupBy(request_id)
        .agg(
            F.max("user_id").alias("user_id"),
            F.max("mode").alias("mode"),
            F.max("error").alias("error"),
            F.transform(items, lambda p: F.struct(*[p[c].alias(c) for c in PREDICTION])).alias(
                "predictions"
            ),
        )
        .select(request_id, response_json().alias("response"))
    )


def score_requests(
    requests: DataFrame,
    ranked: DataFrame,
    by_product: DataFrame,
    products: DataFrame | None,
    raw: str = "raw",
    request_id: str = "request_id",
) -> DataFrame:
    """JSON requests to JSON responses."""
    parsed = parse_requests(requests, raw)
    return respond(answer_rows(parsed, ranked, by_product, products, request_id), request_id)
