from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartloom.functions import quantiles
from cartloom.functions.columns import day_name, hash_percent, ratio, std_from_sums
from cartloom.functions.quantiles import exact_quantiles
from cartloom.functions.ranking import number_sequence, top_k
from cartloom.operators.joins import attach
from tests.conftest import keyed, rows


def test_number_sequence_in_slices(spark):
    rng = random.Random(7)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    data, used = [], set()
    for user, n in ((1, 400), (2, 3), (3, 1), (4, 60)):
        for _ in range(n):
            i = rng.randrange(10_000)
            if i not in used:
                used.add(i)
                data.append((user, rng.choice(days), i))
    df = spark.createDataFrame(data, "u int, d date, i long")
    plain = number_sequence(df, "u", "d", "i", 10_000)
    for limit in (2, 50, 200):
        assert rows(number_sequence(df, "u", "d", "i", limit)) == rows(plain)
    got = keyed(plain, "u", "i")
    for user in (1, 2, 3, 4):
        mine = sorted((d, i) for u, d, i in data if u == user)
        for n, (_, i) in enumerate(mine):
            row = got[(user, i)]
            assert row["position"] == n + 1
            assert row["previous"] == (mine[n - 1][0] if n else None)
            assert row["is_last"] == (n == len(mine) - 1)


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    best = top_k(df, "g", [F.desc("id")], 2)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    assert rows(best.select("g", "rank", "id")) == [
        (0, 1, 999), (0, 2, 996), (1, 1, 997), (1, 2, 994), (2, 1, 998), (2, 2, 995),
    ]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_same_rows_with_salt(spark, how):
    big = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("k"))
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k long, name string")
    small = attach(big, dim, "k", how)
    salted = attach(big, dim, "k", how, spread=["id"], max_rows=2)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    assert rows(small.select("id", "k", "name")) == rows(salted.select("id", "k", "name"))


def quantiles_of(spark, pdf, probs):
    df = spark.createDataFrame(pdf)
    ranges = {}
    for c in pdf.columns:
        v = pdf[c].dropna()
        ranges[c] = (len(v), float(v.min()) if len(v) else None, float(v.max()) if len(v) else None)
    return exact_quantiles(df, ranges, probs)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    n = 4001
    pdf = pd.DataFrame(
        {
            "ids": rng.permutation(n).astype("int64") * 1_000_003,
            "skew": np.exp(rng.normal(0, 6, n)),
            "ties": rng.integers(0, 3, n),
            "one": np.full(n, 5.0),
            "close": 1.0 + rng.integers(0, 50, n) * 2.0**-52,
            "wide": np.where(rng.random(n) < 0.01, 1e12, rng.random(n)),
        }
    )
    probs = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = quantiles_of(spark, pdf, probs)
    for c in pdf.columns:
        assert got[c] == pytest.approx(list(pdf[c].quantile(list(probs))), rel=1e-12), c


def test_exact_quantiles_with_nulls_and_few_rows(spark):
    schema = "a double, b double"
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], schema)
    got = exact_quantiles(df, {"a": (2, 1.0, 4.0), "b": (0, None, None)}, (0.25, 0.5))
    assert got == {"a": [1.75, 2.5], "b": [None, None]}


def test_small_expressions(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 4.0, 1), (2, 4, 6.0, 20.0, 2)], "a int, b int, s double, q double, n int")
    got = df.select(
        ratio("a", "b").alias("r"), std_from_sums("n", "s", "q").alias("sd"), day_name(F.col("b")).alias("d")
    )
    assert rows(got) == [(None, 0.0, "Sun"), (0.5, pytest.approx(2**0.5), "Thu")]
    assert spark.range(1).select(day_name(F.lit(9))).first()[0] is None


def test_hash_percent_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a = df.repartition(3).select("id", hash_percent("id").alias("h"))
    b = df.repartition(7).select("id", hash_percent("id").alias("h"))
    assert rows(a) == rows(b)
    share = a.filter("h < 20").count() / 5000
    assert 0.17 < share < 0.23


def test_many_ranks_take_one_value_a_column_and_row(spark, monkeypatch):
    """Every rank of two columns at once; before, a row was compared with each open rank."""
    r = random.Random(3)
    data = [(r.choice([r.gauss(0, 1), float(r.randrange(5)), -0.0, 1e300]), i % 7 if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b int")
    widths = []

    def array(*columns):
        widths.append(len(columns))
        return F.array(*columns)

    monkeypatch.setattr(quantiles, "F", SimpleNamespace(**{**vars(F), "array": array}))
    want = {c: sorted(float(d[i]) for d in data if d[i] is not None) for i, c in enumerate("ab")}
    ranges = {c: (len(v), v[0], v[-1]) for c, v in want.items()}
    got = quantiles.values_at_ranks(df, ranges, {c: range(len(v)) for c, v in want.items()})
    assert {c: [got[c][i] for i in range(len(v))] for c, v in want.items()} == want
    assert widths and max(widths) <= 2
