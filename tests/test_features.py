from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartloom.operators import features as X
from cartloom.operators import joins as J
from cartloom.operators import sampling as S
from tests.conftest import keyed, rows


@pytest.fixture(scope="module")
def totals(shop):
    return X.pair_totals(shop.prior_orders, shop.prior).persist()


@pytest.fixture(scope="module")
def by_product(shop, totals):
    return X.product_features_ext(X.product_totals(totals), shop.products, shop.departments, shop.aisles).persist()


def test_user_features(shop):
    got = keyed(X.user_features(shop.orders, shop.prior), "user_id")
    assert got[1] == {
        "user_id": 1, "u_total_orders": 4, "u_avg_basket_size": pytest.approx(7 / 3),
        "u_reorder_ratio": pytest.approx(3 / 7), "u_avg_days_between_orders": pytest.approx(37 / 3),
    }
    assert got[3] == {
        "user_id": 3, "u_total_orders": 1, "u_avg_basket_size": None,
        "u_reorder_ratio": None, "u_avg_days_between_orders": None,
    }


def test_product_features(shop):
    got = keyed(X.product_features(shop.prior), "product_id")
    assert got[10] == {
        "product_id": 10, "p_total_purchases": 4, "p_reorder_prob": 0.5, "p_avg_cart_position": 1.25,
    }
    assert 60 not in got


def test_interaction_features(shop):
    got = keyed(X.interaction_features(shop.orders, shop.prior), "user_id", "product_id")
    assert got[(1, 20)] == {
        "user_id": 1, "product_id": 20, "up_total_purchases": 2, "up_first_order_num": 1,
        "up_last_order_num": 3, "up_order_rate": 0.5, "up_order_rate_since_first_play": 0.5,
    }
    assert got[(1, 30)]["up_order_rate"] == pytest.approx(1 / 3)


def test_user_features_ext(shop, totals):
    got = keyed(X.user_features_ext(shop.prior_orders, totals), "user_id")
    gaps = pd.Series([7.0, 0.0])
    one = got[1]
    assert one["user_total_orders"] == 3
    assert one["user_std_days_between"] == pytest.approx(gaps.std())
    assert (one["user_min_days_between"], one["user_max_days_between"]) == (0.0, 7.0)
    assert one["user_avg_basket_size"] == pytest.approx(7 / 3)
    assert (one["user_total_products"], one["user_unique_products"], one["user_total_reorders"]) == (7, 4, 3)
    single = got[2]
    assert single["user_std_days_between"] == 0.0 and single["user_std_order_hour"] == 0.0
    assert single["user_avg_days_between"] is None
    assert got[3]["user_total_products"] is None


def test_product_features_ext(shop, by_product):
    got = keyed(by_product, "product_id")
    assert got[10]["product_std_cart_pos"] == pytest.approx(pd.Series([1, 1, 2, 1]).std())
    assert got[10]["product_unique_users"] == 2
    assert got[40]["product_std_cart_pos"] == 0.0
    assert got[50]["department"] is None and got[50]["dept_avg_reorder_rate"] is None
    assert got[10]["dept_avg_reorder_rate"] == pytest.approx((0.5 + 1 / 3) / 2)


def test_pair_features_ext(shop, totals):
    got = keyed(X.interaction_features_ext(shop.prior_orders, totals), "user_id", "product_id")
    row = got[(1, 30)]
    assert row["up_orders_since_last"] == 1 and row["up_recency_score"] == 0.5
    assert got[(1, 20)]["up_orders_span"] == 2
    assert got[(1, 20)]["up_buy_frequency"] == pytest.approx(2 / 3)
    assert got[(1, 10)]["up_reorder_rate"] == pytest.approx(2 / 3)


def test_training_matrix(shop, totals, by_product):
    matrix = X.training_matrix(shop.orders, totals, shop.train, by_product)
    assert len(matrix.columns) == 32
    got = keyed(matrix, "user_id", "product_id")
    # users 1 and 4 only; product 40 was new in the train order, so it is no candidate
    assert {k: r["reordered"] for k, r in got.items()} == {
        (1, 10): 1, (1, 20): 1, (1, 30): 0, (1, 50): 0, (4, 20): 0,
    }
    assert {k for k in got} == {
        (r["user_id"], r["product_id"]) for r in X.candidates(totals, shop.orders.filter("eval_set='train'")).collect()
    }
    balance = X.label_balance(matrix).first()
    assert (balance["n_rows"], balance["n_positive"], balance["n_negative"]) == (5, 2, 3)


def test_held_out_order_does_not_reach_the_features(spark, shop, by_product):
    """Other rows in the train order change labels only."""
    other = shop.train.filter("order_id <> 4")
    changed = shop.orders.withColumn(
        "days_since_prior_order",
        F.when(F.col("eval_set") == "prior", F.col("days_since_prior_order")).otherwise(99.0),
    )
    totals = X.pair_totals(shop.prior_orders, shop.prior)
    a = X.training_matrix(shop.orders, totals, shop.train, by_product).drop("reordered")
    b = X.training_matrix(changed, totals, other, by_product).drop("reordered")
    assert rows(a) == rows(b)


def test_serving_matrix(shop):
    got = X.serving_matrix(shop.orders, shop.prior)
    assert got.columns == ["user_id", "product_id", *X.SERVING_FEATURES]
    by_key = keyed(got, "user_id", "product_id")
    assert by_key[(2, 40)]["u_avg_days_between_orders"] == 6.0
    assert all(v is not None for r in by_key.values() for v in r.values())
    single = X.serving_matrix(shop.prior_orders, shop.prior)
    assert keyed(single, "user_id", "product_id")[(2, 40)]["u_avg_days_between_orders"] == 0.0


def test_rates_stay_between_zero_and_one(shop, totals):
    for df, cols in (
        (X.interaction_features(shop.orders, shop.prior), ["up_order_rate", "up_order_rate_since_first_play"]),
        (X.interaction_features_ext(shop.prior_orders, totals), ["up_reorder_rate", "up_buy_frequency", "up_recency_score"]),
    ):
        for c in cols:
            assert df.filter(~F.col(c).between(0, 1)).count() == 0


def test_empty_inputs_give_empty_features(shop):
    none = shop.prior.limit(0)
    assert X.product_features(none).count() == 0
    assert X.interaction_features(shop.orders, none).count() == 0
    assert X.serving_matrix(shop.orders, none).count() == 0


def test_joins(spark, shop):
    assert J.order_history(shop.prior_orders, shop.prior).count() == 10
    lines = J.lines_with_department(shop.prior, shop.products, shop.departments)
    assert lines.filter("product_id = 50").count() == 0 and lines.count() == 9
    asked = spark.createDataFrame([(1,), (3,), (777,)], "user_id long")
    assert rows(J.users_without_history(asked, shop.orders, shop.prior)) == [(3,), (777,)]
    orders, chosen = J.history_of(spark.createDataFrame([(2,)], "user_id long"), shop.orders, shop.prior)
    assert rows(orders.select("order_id")) == [(5,), (6,)] and chosen.count() == 2


def test_sampling(shop):
    assert rows(S.sample_users(shop.orders, 2)) == rows(S.sample_users(shop.orders.repartition(5), 2))
    assert S.sample_users(shop.orders, 100).count() == 4
    split = keyed(S.temporal_split(shop.orders), "order_id")
    assert {k for k, r in split.items() if r["split"] == "holdout"} == {4, 6, 7, 9}
    assert [r[0] for r in S.known_user_ids(shop.orders, 3).collect()] == [1, 2, 3]


def test_first_order_flags(shop):
    got = keyed(X.first_order_flags(shop.orders), "order_id")
    assert got[1]["days_since_prior_order"] == 0.0 and got[1]["is_first_order"] == 1
    assert got[2]["is_first_order"] == 0
