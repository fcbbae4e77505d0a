from __future__ import annotations

import numpy as np
import pytest

from cartloom.operators import svd as V

ROWS = "k long, i array<int>, w array<double>"


def made(n: int, terms: int, seed: int):
    """Sparse rows with falling singular values; some rows are empty."""
    r = np.random.default_rng(seed)
    dense = np.zeros((n, terms))
    for a in range(n):
        if a % 9:
            own = r.choice(terms, size=min(terms, 1 + int(r.integers(6))), replace=False)
            dense[a, own] = r.random(len(own)) + (own < 4) * (4 - own).clip(0)
    return dense


def table(spark, dense, parts: int = 3):
    data = []
    for k, row in enumerate(dense):
        own = np.flatnonzero(row)
        data.append((k, [int(x) for x in own], [float(x) for x in row[own]]))
    return spark.createDataFrame(data, ROWS).repartition(parts)


def check(found: V.Svd, dense: np.ndarray, k: int, digits: float = 1e-6) -> None:
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert found.values == pytest.approx(s[:k], abs=digits)
    signs = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    loadings = {r["i"]: r["loadings"] for r in found.loadings.collect()}
    got = np.array([loadings.get(i, [0.0] * k) for i in range(dense.shape[1])])
    assert np.allclose(got, (vt[:k] * signs[:, None]).T, atol=digits)
    scores = {r["k"]: r["scores"] for r in found.scores.collect()}
    assert np.allclose([scores[i] for i in range(len(dense))], u[:, :k] * s[:k] * signs, atol=digits)


@pytest.mark.parametrize("factor_bytes", [1 << 20, 0], ids=["passes", "joins"])
def test_equals_a_dense_decomposition(spark, factor_bytes):
    dense = made(70, 30, 1)
    found = V.truncated_svd(table(spark, dense), "k", 3, 30, extra=6, factor_bytes=factor_bytes, tolerance=1e-13)
    check(found, dense, 3)


def test_fewer_directions_than_asked(spark):
    dense = made(40, 12, 2)
    dense[:, 3:] = 0
    check(V.truncated_svd(table(spark, dense), "k", 2, 12), dense, 2)


def test_partial_products_added_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "DIRECT_BYTES", 0)
    dense = made(60, 20, 3)
    check(V.truncated_svd(table(spark, dense, 9), "k", 3, 20), dense, 3)


def test_pieces_of_long_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "ENTRIES", 3)
    dense = made(60, 20, 4)
    check(V.truncated_svd(table(spark, dense), "k", 3, 20), dense, 3)


def test_edges(spark):
    none = spark.createDataFrame([], ROWS)
    found = V.truncated_svd(none, "k", 2, 5)
    assert found.values.tolist() == [0.0, 0.0] and found.scores.count() == 0
    with pytest.raises(ValueError):
        V.truncated_svd(none, "k", 6, 5)


def test_start_block_is_the_same_in_every_task():
    whole = V.start_block(np.arange(50), 7)
    assert (V.start_block(np.array([13, 4]), 7) == whole[[13, 4]]).all()
    assert np.abs(whole).max() <= 1 and np.linalg.matrix_rank(whole) == 7


def test_checks_join_no_single_rows(spark):
    """The one row of checks is not a product of tables, whatever may be broadcast."""
    rows = spark.createDataFrame([(k, [0, 1, 2], [1.0 + k, 2.0, 0.5 * k * k]) for k in range(9)], ROWS)
    found = V.checks(rows, "k", V.truncated_svd(rows, "k", 2, 3))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.columns == ["n_rows", "squared_norm", "residual_adds_up", "orthonormal", "lengths_are_values", "vectors_are_scaled"]
    (got,) = found.collect()
    assert got["n_rows"] == 9 and all(got[c] for c in found.columns[2:])
