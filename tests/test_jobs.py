from __future__ import annotations

import json

import pytest

from cartloom.__main__ import main
from cartloom.operators import features as X
from cartloom.plans import jobs
from cartloom.sources import star
from cartloom.sources.tables import read_csv, write_csv
from tests.conftest import keyed, rows

SF = "/root/testdata/sf0.001"


def test_feature_batch_to_csv(spark, shop, tmp_path):
    jobs.feature_batch(shop.tables, f"{tmp_path}/out", f"{tmp_path}/work", "csv")
    totals = X.pair_totals(shop.prior_orders, shop.prior)
    by_product = X.product_features_ext(X.product_totals(totals), shop.products, shop.departments, shop.aisles)
    want = {
        "user_features": X.user_features_ext(shop.prior_orders, totals),
        "product_features": by_product,
        "user_product_features": X.interaction_features_ext(shop.prior_orders, totals),
        "final_features_train": X.training_matrix(shop.orders, totals, shop.train, by_product),
    }
    for name, df in want.items():
        assert rows(read_csv(spark, f"{tmp_path}/out/{name}", df.schema)) == rows(df), name


def test_feature_batch_stops_on_bad_orders(spark, shop, tmp_path):
    bad = spark.createDataFrame([(99, 1, "prior", 2, 0, 0, None)], shop.orders.schema)
    tables = shop.tables.__class__(**(vars(shop.tables) | {"orders": shop.orders.union(bad)}))
    with pytest.raises(ValueError):
        jobs.feature_batch(tables, f"{tmp_path}/out", f"{tmp_path}/work")


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("package"))
    return jobs.train_package(star.Star(spark, SF).tables(), path, n_users=80, rounds=3, depth=3)


def test_nightly_lists(spark, package, tmp_path):
    ranked = jobs.write_ranked(package, f"{tmp_path}/ranked")
    first = rows(jobs.nightly(package, ranked, f"{tmp_path}/lists", "2024-01-31", 10))
    lists = jobs.nightly(package, ranked, f"{tmp_path}/lists", "2024-01-31", 10)
    assert rows(lists) == first
    users = package.orders.select("user_id").distinct().count()
    assert lists.select("user_id").distinct().count() == users
    assert lists.groupBy("user_id").count().filter("count > 10").count() == 0
    best = keyed(ranked.filter("rank <= 10"), "user_id", "rank")
    for key, row in keyed(lists.filter("mode = 'Personalized'"), "user_id", "rank").items():
        assert row["product_id"] == best[key]["product_id"]


def test_command_line(spark, tmp_path):
    for name, df in star.Star(spark, SF).tables().named().items():
        write_csv(df, f"{tmp_path}/csv/{name}.csv")
    t = str(tmp_path)
    main(["features", f"{t}/csv", f"{t}/features"])
    assert spark.read.parquet(f"{t}/features/final_features_train").count() == 2535
    main(["train", f"{t}/csv", f"{t}/package", "--rounds", "2", "--users", "60"])
    main(["nightly", f"{t}/package", f"{t}/night", "2024-02-01", "-k", "5"])
    requests = ['{"user_id": 3107, "top_k": 5, "threshold": 0.0}', '{"user_id": 7, "top_k": 3}']
    spark.createDataFrame([(r,) for r in requests], "v string").coalesce(1).write.text(f"{t}/requests")
    for extra, out in (([], "batch"), (["--stream"], "stream")):
        main(["answer", f"{t}/package", f"{t}/night/ranked", f"{t}/requests", f"{t}/{out}", *extra])
        answers = [json.loads(r["response"]) for r in spark.read.parquet(f"{t}/{out}/responses").collect()]
        assert {a["user_id"]: (a["mode"], len(a["predictions"])) for a in answers} == {
            3107: ("Global Popularity", 5), 7: ("Personalized", 3),
        }
