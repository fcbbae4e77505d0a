from __future__ import annotations

import random

import pytest

from cartloom.operators import evaluate as E
from tests.conftest import keyed, rows

TRUE = "user_id long, product_id long, reordered int"
PROB = "user_id long, product_id long, score double"


def test_precision_and_recall(spark):
    y_true = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 1), (1, 3, 0), (2, 1, 0), (3, 5, 1), (3, 5, 1), (3, 6, 1)], TRUE
    )
    # user 1: scores tie at the cut; user 2: nothing reordered; user 4: no truth
    y_prob = spark.createDataFrame(
        [(1, 3, 0.5), (1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.9), (3, 5, 0.7), (4, 1, 0.2)], PROB
    )
    hits = keyed(E.per_user_hits(y_true, y_prob, 2), "user_id")
    assert hits[1] == {"user_id": 1, "hits": 2, "n_actual": 2, "precision": 1.0, "recall": 1.0}
    assert hits[3] == {"user_id": 3, "hits": 1, "n_actual": 3, "precision": 0.5, "recall": pytest.approx(1 / 3)}
    assert set(hits) == {1, 3}
    got = E.precision_recall_at_k(y_true, y_prob, 2).first()
    assert (got["precision_at_k"], got["recall_at_k"]) == (0.75, pytest.approx(2 / 3))


def test_no_user_gives_zero(spark):
    y_true = spark.createDataFrame([(1, 1, 0)], TRUE)
    y_prob = spark.createDataFrame([(1, 1, 0.3)], PROB)
    assert tuple(E.precision_recall_at_k(y_true, y_prob).first()) == (0.0, 0.0, 0)


def test_recall_grows_with_k(spark):
    rng = random.Random(5)
    data = [(u, p, int(rng.random() < 0.3), rng.random()) for u in range(20) for p in range(15)]
    df = spark.createDataFrame(data, "user_id long, product_id long, reordered int, score double")
    recalls = [E.precision_recall_at_k(df, df, k).first()["recall_at_k"] for k in (1, 3, 7, 15)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["spread", "ties", "crowded"])
@pytest.mark.parametrize("buckets", [2, 4, 64])
def test_auc_and_average_precision(spark, kind, buckets, monkeypatch):
    rng = random.Random(len(kind))
    pairs = []
    for _ in range(400):
        y = int(rng.random() < 0.3)
        s = rng.random() + 0.3 * y
        if kind == "ties":
            s = round(s, 1)
        elif kind == "crowded":
            s = 0.5 + s * 1e-9
        pairs.append((s, y))
    df = spark.createDataFrame(pairs, "s double, y int")
    points = E.curve_points(df, "y", "s", buckets)
    got = sorted(tuple(r) for r in points.collect())
    for s, pos, neg, pos_above, neg_above in got:
        assert pos == sum(1 for a, y in pairs if a == s and y == 1)
        assert neg == sum(1 for a, y in pairs if a == s and y == 0)
        assert pos_above == sum(1 for a, y in pairs if a > s and y == 1)
        assert neg_above == sum(1 for a, y in pairs if a > s and y == 0)
    assert E.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute_auc(pairs))
    seen, area = 0, 0.0
    total = sum(y for _, y in pairs)
    for i, s in enumerate(sorted({s for s, _ in pairs}, reverse=True)):
        pos = sum(y for a, y in pairs if a >= s)
        area += (pos - seen) * pos / sum(1 for a, _ in pairs if a >= s)
        seen = pos
    assert E.average_precision(df, "y", "s").first()[0] == pytest.approx(area / total)


def test_auc_with_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    assert E.roc_auc(df, "y", "s").first()[0] is None


def test_confusion_and_accuracy(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    got = E.confusion(df, "y", "s").first().asDict()
    assert got == {
        "tp": 1, "fp": 1, "fn": 1, "tn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5,
    }
    assert E.accuracy(df, "y", "s").first()[0] == 0.5


def test_segments(spark):
    test = spark.createDataFrame(
        [(1, 1, 5, 49), (2, 1, 6, 50), (3, 1, 2, None)],
        "user_id long, product_id long, u_total_orders int, p_total_purchases long",
    )
    scores = spark.createDataFrame(
        [(1, 1, 1, 0.2), (2, 1, 0, 0.4), (3, 1, 0, 0.6)],
        "user_id long, product_id long, actual int, predicted_prob double",
    )
    merged = E.with_predictions(test, scores)
    assert rows(E.cold_user_error(merged)) == [(pytest.approx(0.4), 0.4, 2, 1)]
    assert rows(E.rare_item_error(merged)) == [(0.2, 0.4, 1, 1)]
