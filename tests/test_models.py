from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.operators import evaluate as E
from cartloom.operators import features as X
from cartloom.operators import models as M
from cartloom.operators.logistic import _derivatives, fit_logistic, predict_logistic
from cartloom.sources.package import Package, load_package, save_package
from tests.conftest import keyed, rows


@pytest.fixture(scope="module")
def matrix(spark):
    """Rows whose label follows two of the features."""
    rng = random.Random(11)
    data = []
    for user in range(60):
        for product in range(12):
            values = [rng.random() for _ in X.SERVING_FEATURES]
            signal = 3 * values[3] + 2 * values[10] - 2.5 + rng.gauss(0, 0.5)
            data.append((user, product, *values, int(signal > 0)))
    columns = ", ".join(f"{c} double" for c in X.SERVING_FEATURES)
    return spark.createDataFrame(data, f"user_id long, product_id long, {columns}, reordered int").persist()


@pytest.mark.parametrize(
    "build",
    [
        lambda n: M.logistic(X.SERVING_FEATURES, n, 200),
        lambda n: M.forest(X.SERVING_FEATURES, 10, 5),
        lambda n: M.boosted(X.SERVING_FEATURES, 5, 3),
    ],
    ids=["logistic", "forest", "boosted"],
)
def test_models_find_the_signal(matrix, build):
    scored = M.predict(M.fit(build(matrix.count()), matrix), matrix)
    assert scored.columns == ["user_id", "product_id", "reordered", "prediction", "reorder_probability"]
    assert scored.filter("reorder_probability < 0 or reorder_probability > 1").count() == 0
    assert E.roc_auc(scored, "reordered", "reorder_probability").first()[0] > 0.85
    assert E.accuracy(scored, "reordered", "reorder_probability").first()[0] > 0.75


def test_compare(matrix):
    got = keyed(
        M.compare(matrix, max_iter=50, trees=5, tree_depth=4, rounds=3, boost_depth=3), "model", "metric"
    )
    assert set(got) == {
        *((m, x) for m in ("logistic", "forest", "boosted") for x in ("accuracy", "roc_auc")),
        ("boosted", "precision_at_k"), ("boosted", "recall_at_k"),
    }
    assert all(0 <= r["value"] <= 1 for r in got.values())


def test_align_orders_and_fills(spark):
    df = spark.createDataFrame([(1, 2, None)], "b int, a int, c double")
    got = M.align(df, ["a", "missing", "b", "c"])
    assert got.columns == ["a", "missing", "b", "c"]
    assert tuple(got.first()) == (2.0, 0.0, 1.0, 0.0)


def test_feature_columns(matrix):
    assert M.feature_columns(matrix) == list(X.SERVING_FEATURES)


def test_package_round_trip(spark, shop, matrix, tmp_path):
    model = M.fit(M.forest(X.SERVING_FEATURES, 5, 3), matrix)
    package = Package(
        model=model,
        features=M.model_features(model),
        user_features=X.user_features(shop.orders, shop.prior),
        product_features=X.product_features(shop.prior),
        orders=shop.orders,
        prior=shop.prior,
        products=shop.products,
    )
    save_package(package, f"{tmp_path}/p")
    back = load_package(spark, f"{tmp_path}/p")
    assert back.features == list(X.SERVING_FEATURES)
    assert rows(M.predict(back.model, matrix)) == rows(M.predict(model, matrix))
    assert rows(back.product_features) == rows(package.product_features)
    serving = X.serving_matrix(back.orders, back.prior, back.product_features)
    assert M.predict(back.model, serving).count() == serving.count()


def test_training_rows_use_past_orders_only(shop):
    got = keyed(M.labelled_serving_matrix(shop.orders, shop.prior, shop.train), "user_id", "product_id")
    assert got[(1, 10)]["u_total_orders"] == 3  # the train order is the fourth
    assert {k: r["reordered"] for k, r in got.items()} == {
        (1, 10): 1, (1, 20): 1, (1, 30): 0, (1, 50): 0, (4, 20): 0,
    }


def test_newton_fit_is_the_optimum(spark, matrix):
    """Against the library's fit of the same objective, and by its own certificate."""
    found = fit_logistic(matrix, X.SERVING_FEATURES)
    assert max(map(abs, found.gradient)) < 1e-9 < found.curvature
    assert all(later <= earlier + 1e-12 for earlier, later in zip(found.losses, found.losses[1:]))
    other = M.fit(M.logistic(X.SERVING_FEATURES, matrix.count()), matrix)
    assert found.weights == pytest.approx((*other.stages[-1].coefficients, other.stages[-1].intercept), abs=2e-3)
    keys = ["user_id", "product_id"]
    both = predict_logistic(found, matrix, keys).join(M.predict(other, matrix, keys).withColumnRenamed("reorder_probability", "o"), keys)
    assert both.filter("abs(reorder_probability - o) > 1e-3").count() == 0
    assert found.table(spark).count() == len(X.SERVING_FEATURES) + 1


def test_a_moved_weight_has_a_gradient(matrix):
    """The certificate fails for weights that are not the optimum."""
    known = matrix.withColumn("y", matrix["reordered"].cast("double"))
    found = fit_logistic(matrix, X.SERVING_FEATURES)
    moved = np.array(found.weights)
    moved[3] += 0.01
    at_moved = _derivatives(known.select("y", *found.features), found.centre, found.scale, moved, found.n_rows, 1 / found.n_rows)
    assert np.abs(at_moved[1]).max() > 1e-4


def test_newton_fit_of_odd_rows(spark, matrix):
    """Null features are zeros, a constant one has no weight, rows without a label do not count."""
    feature = X.SERVING_FEATURES[0]
    odd = matrix.withColumn(feature, F.lit(None).cast("double")).unionByName(
        matrix.limit(5).withColumn("reordered", F.lit(None).cast("int"))
    )
    found = fit_logistic(odd, X.SERVING_FEATURES)
    assert found.weights[0] == 0 and found.n_rows == matrix.count()
    assert fit_logistic(matrix.drop(feature), X.SERVING_FEATURES).weights == pytest.approx(found.weights)
    with pytest.raises(ValueError, match="both labels"):
        fit_logistic(matrix.filter("reordered = 1"), X.SERVING_FEATURES)
    with pytest.raises(ValueError, match="both labels"):
        fit_logistic(matrix.limit(0), X.SERVING_FEATURES)


def test_boosting_keeps_no_nodes(matrix):
    """Walking down again finds the trees that kept nodes find, without a checkpoint a level."""
    plain = M.boosted(X.SERVING_FEATURES, 3, 3)
    kept = M.boosted(X.SERVING_FEATURES, 3, 3)
    kept.getStages()[-1].setCacheNodeIds(True)
    assert not plain.getStages()[-1].getCacheNodeIds()
    found = [M.fit(p, matrix).stages[-1].toDebugString.split("\n", 1)[1] for p in (plain, kept)]
    assert found[0] == found[1]


@pytest.mark.parametrize("build", [lambda: M.forest(X.SERVING_FEATURES, 10, 2), lambda: M.boosted(X.SERVING_FEATURES, 2, 2)])
def test_rows_of_a_fit_are_dealt_to_more_tasks(matrix, monkeypatch, build):
    seen = []
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    few = matrix.coalesce(2)
    M.fit(build(), few)
    monkeypatch.setattr(M, "TASK_BYTES", 100 * (M.ROW_BYTES + 10 * M.TREE_BYTES))
    M.fit(build(), few)
    assert seen[0] == (2, 720)
    assert seen[1][0] >= 5 and seen[1][1] == 720


def test_a_forest_counts_its_trees():
    n = 10_000_000
    small, large = (M.fit_tasks(M.forest(X.SERVING_FEATURES, t), n) for t in (10, 100))
    assert small < large and M.fit_tasks(M.boosted(X.SERVING_FEATURES), 1000) == 1
    assert large * M.TASK_BYTES >= n * 100 * M.TREE_BYTES
