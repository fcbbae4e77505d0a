from __future__ import annotations

import numpy as np
import pytest

from cartloom.operators import profile as P
from tests.conftest import keyed, rows


def test_missing_report(shop):
    got = rows(P.missing_report({"orders": shop.orders, "products": shop.products, "aisles": shop.aisles}))
    assert got == [
        ("aisles", None, 0, 0.0),
        ("orders", "days_since_prior_order", 4, pytest.approx(400 / 9)),
        ("products", "product_name", 1, 20.0),
    ]


def test_missing_report_of_an_empty_table(shop):
    assert rows(P.missing_report({"orders": shop.orders.limit(0)})) == [("orders", None, 0, 0.0)]


def test_quality_rule(spark, shop):
    P.require_first_order_quality(shop.orders)
    bad = shop.orders.unionByName(spark.createDataFrame([(99, 1, "prior", 2, 0, 0, None)], shop.orders.schema))
    assert P.first_order_quality(bad).first()["n_violations"] == 1
    with pytest.raises(ValueError):
        P.require_first_order_quality(bad)


def test_gap_stats_drop_zero_and_null(shop):
    got = P.order_gap_stats(shop.orders).first().asDict()
    assert got == {"mean_gap": 17.75, "median_gap": 17.5, "pct_weekly": 50.0, "pct_monthly": 50.0}


def test_absent_day_is_null(shop):
    got = [tuple(r) for r in P.orders_by_dow(shop.orders.filter("order_dow <> 3")).collect()]
    assert [r[1] for r in got] == ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
    assert got[3] == (3, "Wed", None, False)
    assert [r[1] for r in got if r[3]] == ["Sun"]  # Sun and Fri tie at 2


def test_orders_per_user(shop):
    got = P.orders_per_user_stats(shop.prior_orders, many=2).first().asDict()
    assert got == {"min_orders": 1, "median_orders": 1.0, "max_orders": 3, "pct_above": 25.0}


@pytest.mark.parametrize("sizes", [[1, 2, 2, 3, 55, 41, 40, 17], [4, 4, 4]])
def test_basket_histogram_like_numpy(spark, sizes):
    lines = [(o, p) for o, n in enumerate(sizes) for p in range(n)]
    got = P.basket_size_hist(spark.createDataFrame(lines, "order_id long, product_id long")).collect()
    counts, edges = np.histogram(np.minimum(sizes, 40), bins=40)
    assert [r["n_orders"] for r in got] == counts.tolist()
    assert [r["bin_low"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1]["bin_high"] == pytest.approx(edges[-1])


def test_positions_absent_are_zero(shop):
    assert rows(P.reorder_at_positions(shop.train)) == [(1, 0.5), (5, 0.0), (10, 0.0)]


def test_departments(shop):
    totals = P.department_totals(shop.train, shop.products, shop.departments)
    assert [tuple(r) for r in P.department_volume(totals).collect()] == [("dry", 2), ("fresh", 2)]
    assert [tuple(r) for r in P.department_reorder(totals, 1).collect()] == [("fresh", 1.0)]


def test_describe_like_pandas(shop):
    got = keyed(P.describe({"orders": shop.orders, "aisles": shop.aisles}), "table_name", "column_name")
    want = shop.orders.toPandas().describe()
    for c in ("order_id", "days_since_prior_order", "order_hour_of_day"):
        row = got[("orders", c)]
        for ours, theirs in zip(
            ("n", "mean", "std", "min", "q25", "q50", "q75", "max"),
            ("count", "mean", "std", "min", "25%", "50%", "75%", "max"),
            strict=True,
        ):
            assert row[ours] == pytest.approx(want.loc[theirs, c]), (c, ours)
    assert ("orders", "eval_set") not in got


def test_correlations_like_pandas(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(1e6, 1, 300)
    data = [
        (float(b), None if i % 7 == 0 else float(b + rng.normal()), int(i % 5), 3)
        for i, b in enumerate(base)
    ]
    df = spark.createDataFrame(data, "a double, b double, c int, constant int").repartition(5)
    got = keyed(P.correlations({"t": df, "single": df.select("a", "constant")}), "table_name", "x", "y")
    want = df.toPandas().drop(columns="constant").corr()
    assert {k[0] for k in got} == {"t"} and len(got) == 9
    for x in "abc":
        for y in "abc":
            assert got[("t", x, y)]["r"] == pytest.approx(want.loc[x, y], abs=1e-9)


def test_catalogue_lists_thirty():
    assert len(P.FEATURES) == 30
    assert len({f[:2] for f in P.FEATURES}) == 30


def test_correlations_multiply_no_masks_without_gaps(spark, monkeypatch):
    """A column without nulls adds one entry to a row's vector; one with nulls is left out pair by pair."""
    r = np.random.default_rng(2)
    data = r.normal(size=(60, 4)).tolist()
    whole = spark.createDataFrame(data, "a double, b double, c double, d double")
    holed = spark.createDataFrame([(*x[:3], None if i % 4 else x[3]) for i, x in enumerate(data)], whole.schema)
    widths = []
    real = P._products

    def products(*args):
        found = real(*args)
        widths.append(len(found))
        return found

    monkeypatch.setattr(P, "_products", products)
    monkeypatch.setattr(P, "STATISTICS", 3)
    got = keyed(P.correlations({"whole": whole, "holed": holed}), "table_name", "x", "y")
    assert widths == [5, 10]
    for name, df in (("whole", whole), ("holed", holed)):
        wanted = df.toPandas().astype(float).corr()
        for x in "abcd":
            for y in "abcd":
                assert got[name, x, y]["r"] == pytest.approx(wanted.loc[x, y])
