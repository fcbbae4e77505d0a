from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cartloom.functions.requests import parse_requests
from cartloom.operators import features as X
from cartloom.operators import joins as J
from cartloom.operators import recommend as R
from cartloom.streaming.scoring import read_requests, score_lines, score_stream
from tests.conftest import keyed, rows


@pytest.fixture(scope="module")
def scored(shop):
    return X.interaction_features(shop.orders, shop.prior).select(
        "user_id", "product_id", F.col("up_order_rate").alias("reorder_probability")
    )


@pytest.fixture(scope="module")
def popular(shop):
    return X.product_features(shop.prior).persist()


@pytest.fixture(scope="module")
def ranked(scored):
    return R.ranked_pairs(scored).persist()


def test_personal(scored, shop):
    got = R.recommend_personal(scored, shop.products, 3, 0.3).filter("user_id = 1").orderBy("rank")
    assert [(r["product_id"], r["product_name"]) for r in got.collect()] == [
        (10, "Red Apple"), (20, 'green apple, "large"'), (30, "Bread"),
    ]


def test_ties_go_to_the_smaller_product(scored, shop):
    got = R.recommend_personal(scored, shop.products, 1, 0.0).filter("user_id = 2").collect()
    assert [r["product_id"] for r in got] == [10]


def test_unlisted_and_missing_catalogue(scored, shop):
    got = keyed(R.recommend_personal(scored, shop.products, 9).filter("user_id = 1"), "product_id")
    assert got[50]["product_name"] is None
    plain = R.recommend_personal(scored, None, 9)
    assert {r["product_name"] for r in plain.collect()} == {"Unknown Product"}


def test_cold(popular, shop):
    got = [tuple(r) for r in R.recommend_cold(popular, shop.products, 3).orderBy("rank").collect()]
    assert [(r[0], r[1]) for r in got] == [(1, 10), (2, 20), (3, 30)]
    assert R.recommend_cold(popular, shop.products, 5, 0.4).count() == 1


def test_routing(spark, scored, popular, shop):
    asked = spark.createDataFrame([(1,), (2,), (3,), (999,), (999,), (None,)], "user_id long")
    known = R.users_with_history(shop.orders, shop.prior)
    got = R.recommend_routed(asked, known, scored, popular, shop.products, 2, 0.0)
    modes = {(r["user_id"], r["mode"]) for r in got.collect()}
    assert modes == {
        (1, "Personalized"), (2, "Personalized"), (3, "Global Popularity"), (999, "Global Popularity"),
    }
    assert got.groupBy("user_id").count().filter("count <> 2").count() == 0
    summary = keyed(R.summary(got), "user_id")
    assert summary[3] == {"user_id": 3, "n_items": 2, "highest_probability": 0.5, "mode": "Global Popularity"}


def test_minimum_orders(spark, shop):
    assert rows(R.users_with_history(shop.orders, shop.prior, 3)) == [(1,)]


CASES = [
    ('{"user_id": 1, "top_k": 2, "threshold": 0.5}', (1, 2, 0.5)),
    ('{"user_id": 1}', (1, 10, 0.0)),
    ('{"dataframe_records": [{"user_id": 2, "top_k": 5}, {"user_id": 9}]}', (2, 5, 0.0)),
    ('{"user_id": "7", "top_k": "3", "threshold": " 0.25 "}', (7, 3, 0.25)),
    ('{"user_id": 7.9, "top_k": 2.0, "threshold": 1}', (7, 2, 1.0)),
    ('{"user_id": true}', (1, 10, 0.0)),
    ('{"user_id": 9007199254740993}', (9007199254740993, 10, 0.0)),
    ('{"user_id": 3, "threshold": 1.5e-1}', (3, 10, 0.15)),
    ('{"user_id": 5, "top_k": 0}', (5, 0, 0.0)),
    ('{"user_id": 5, "other": [1, {"a": 2}]}', (5, 10, 0.0)),
    ('{"user_id": "7.9"}', "user_id"),
    ('{"user_id": null}', "user_id"),
    ('{"user_id": [1]}', "user_id"),
    ('{"top_k": 3}', "user_id"),
    ('{"user_id": 1, "top_k": null}', "top_k"),
    ('{"user_id": 1, "top_k": "many"}', "top_k"),
    ('{"user_id": 1, "top_k": -1}', "top_k"),
    ('{"user_id": 1, "threshold": "x"}', "threshold"),
    ('{"user_id": 1', "not JSON"),
    ("", "not JSON"),
    (None, "not JSON"),
    ("[1, 2]", "user_id"),
    ("3", "user_id"),
    ('{"dataframe_records": []}', "Empty or invalid"),
    ('{"dataframe_records": {"user_id": 1}}', "Empty or invalid"),
    ('{"dataframe_records": null}', "Empty or invalid"),
    ('{"dataframe_records": [5]}', "user_id"),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "request_id int, raw string")
    got = keyed(parse_requests(df), "request_id")
    for i, (raw, want) in enumerate(CASES):
        row = got[i]
        if isinstance(want, tuple):
            assert (row["user_id"], row["top_k"], row["threshold"]) == want, raw
            assert row["error"] is None
        else:
            assert want in row["error"], raw
            assert row["user_id"] is None


REQUESTS = [
    ('{"user_id": 1, "top_k": 2, "threshold": 0.5}', "Personalized", [10, 20]),
    ('{"user_id": 1, "top_k": 2, "threshold": 0.99}', "Personalized", []),
    ('{"user_id": 9999999, "top_k": 5, "threshold": 0.0}', "Global Popularity", [10, 20, 30, 40, 50]),
    ('{"user_id": 3, "top_k": 1}', "Global Popularity", [10]),
    ('{"user_id": 9999999, "top_k": 5, "threshold": 0.9}', "Global Popularity", []),
    ('{"user_id": 8888888, "top_k": 0}', "Global Popularity", []),
    ('{"user_id": 1, "top_k": 0}', "Personalized", []),
    ('{"user_id": 1, "top_k": 100000}', "Personalized", [10, 20, 30, 50]),
]


def test_score_requests(spark, shop, ranked, popular):
    sent = [r[0] for r in REQUESTS] + ["{bad"]
    df = spark.createDataFrame(list(enumerate(sent)), "request_id int, raw string")
    got = keyed(R.score_requests(df, ranked, popular, shop.products), "request_id")
    assert len(got) == len(sent)
    for i, (raw, mode, products) in enumerate(REQUESTS):
        answer = json.loads(got[i]["response"])
        assert answer["mode"] == mode, raw
        assert answer["user_id"] == json.loads(raw)["user_id"]
        assert [p["product_id"] for p in answer["predictions"]] == products, raw
        probabilities = [p["reorder_probability"] for p in answer["predictions"]]
        assert probabilities == sorted(probabilities, reverse=True)
    assert json.loads(got[len(REQUESTS)]["response"]) == {"error": "Invalid input format: not JSON"}
    unnamed = json.loads(got[7]["response"])["predictions"][3]
    assert unnamed["product_name"] is None and "product_name" in unnamed


def test_wide_catalogue_goes_without_broadcast(spark, shop, ranked, popular, scored, monkeypatch):
    """The same answers when neither catalogue nor popular list may be broadcast."""
    sent = spark.createDataFrame(
        [(i, r[0]) for i, r in enumerate(REQUESTS)], "request_id int, raw string"
    )
    asked = spark.createDataFrame([(1,), (2,), (999,)], "user_id long")
    known = R.users_with_history(shop.orders, shop.prior)

    def results():
        return (
            rows(R.score_requests(sent, ranked, popular, shop.products)),
            rows(R.recommend_routed(asked, known, scored, popular, shop.products, 4)),
        )

    want = results()
    joined = J.attach
    monkeypatch.setattr(
        R, "attach", lambda *a, **kw: joined(*a, **{**kw, "max_rows": 0})
    )
    assert results() == want


def test_stream_equals_batch(spark, shop, ranked, popular, tmp_path):
    sent = [r[0] for r in REQUESTS] + ["{bad", REQUESTS[0][0], REQUESTS[0][0]]
    lines = spark.createDataFrame([(s,) for s in sent], "raw string")
    lines.repartition(3).write.text(f"{tmp_path}/in")
    score_stream(
        read_requests(spark, f"{tmp_path}/in", files_per_trigger=1),
        ranked, popular, shop.products, f"{tmp_path}/out", f"{tmp_path}/check",
    ).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("raw", "response")
    want = score_lines(lines.select(F.lit("f").alias("file"), "raw"), ranked, popular, shop.products)
    assert got.count() == len(sent)
    assert rows(got) == rows(want.select("raw", "response"))
