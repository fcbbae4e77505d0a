"""Physical plans: no cross joins or Python UDFs, pruned scans, no shuffle on bucket keys."""

from __future__ import annotations

import re

import pytest

from cartloom.operators import features as X
from cartloom.operators import models as M
from cartloom.operators import recommend as R
from cartloom.plans.data import Data
from cartloom.plans.queries import QUERIES
from cartloom.sources import stage, star

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("model_")))
def test_no_cross_join_or_python_udf(spark, no_auto_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "FlatMapGroupsInPandas"):
        assert bad not in text
    assert "MapInPandas" not in text


def test_scans_are_pruned(spark):
    full = QUERIES["orders_by_hour"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_hour_of_day:int>" in full
    train = QUERIES["target_distribution"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*eval_set.*train", train)


@pytest.mark.parametrize("size,want", [(0, 8), (10, 8), (2 << 30, 16), (100 << 40, 1 << 20)])
def test_bucket_count(size, want):
    assert stage.bucket_count(size) == want


EXCHANGES = {
    "join_prior_orders": 0,
    "user_features": 1,
    "interaction_features": 3,
    "serving_matrix": 3,
    "feature_matrix": 2,  # both of them user statistics, not pairs
    "candidates": 1,
    "user_features_ext": 2,
}


@pytest.mark.parametrize("name", sorted([*EXCHANGES, "training_matrix", "recommend_routed"]))
def test_bucketed_tables(spark, no_auto_broadcast, name):
    """Joined without moving orders or lines."""
    df = QUERIES[name](spark, SF)
    assert "SelectedBucketsCount: 8 out of 8" in plan(df)
    if name in EXCHANGES:
        assert plan(df).count("Exchange hashpartitioning") <= EXCHANGES[name]


def test_requests_read_the_head_of_the_ranked_table(spark):
    d = Data(spark, SF)
    deepest = d.parsed_requests.agg({"top_k": "max"}).first()[0]
    text = plan(R.answer_rows(d.parsed_requests, d.ranked, d.product_features, d.products))
    assert f"LessThanOrEqual(rank,{deepest})" in text
    assert re.search(r"BroadcastHashJoin \[\w+#\d+L\], \[\w+#\d+L\], LeftSemi", text)


def test_nightly_lists_do_not_rank_again(spark):
    d = Data(spark, SF)
    known = d.ranked.filter("rank = 1").select("user_id")
    users = d.orders.select("user_id").distinct()
    text = plan(R.recommend_routed(users, known, d.ranked, d.product_features, d.products, 5))
    assert "WindowGroupLimit" not in text and "LessThanOrEqual(rank,5)" in text


def test_lines_are_not_moved_to_be_flagged_or_to_give_labels(spark, no_auto_broadcast):
    """Only first purchases go to the lines of their order, and only held-out lines to the pairs of their user."""
    d = Data(spark, SF)
    assert d.star.order_products.columns
    lines = d.star._staged("lines", lambda: None, bucket_by="order_id")
    text = plan(star.flag_reorders(lines))
    # partial minima by pair, then a row of each pair by order
    assert text.count("Exchange hashpartitioning") == 2 and "SelectedBucketsCount: 8 out of 8" in text
    text = plan(X.labelled(d.pair_totals.join(d.train_orders, "user_id"), d.train_orders, d.train))
    # the train orders and the labels, both by user
    assert text.count("Exchange hashpartitioning") == 2


def test_requests_are_parsed_by_many_tasks(spark):
    assert re.search(r"Exchange hashpartitioning\(c_custkey#\d+L?, 8\), REPARTITION_BY_NUM", plan(Data(spark, SF).requests))


def test_pairs_stay_in_their_buckets_where_tasks_outnumber_them(spark, no_auto_broadcast):
    """The matrices bring users and labels to the buckets of the pairs."""
    d, key = Data(spark, SF), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    tables = d.orders, d.pair_totals, d.train, d.product_features_ext
    serving = d.orders, d.prior, d.train, d.product_features, d.pair_totals
    spark.conf.set(key, "64")
    try:
        for df in (X.training_matrix(*tables, d._buckets()), M.labelled_serving_matrix(*serving, d._buckets())):
            assert df.rdd.getNumPartitions() == d._buckets()
    finally:
        spark.conf.set(key, before)
