from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from cartloom.operators import features as X
from cartloom.operators.recommend import ranked_pairs
from cartloom.sources import ranked_store as S
from tests.conftest import rows

ORDERS = "order_id long, user_id long, order_number int"
LINES = "order_id long, product_id long, reordered int, add_to_cart_order int"


def made(users: int = 40, seed: int = 1):
    r = random.Random(seed)
    orders, lines = [], []
    for user in range(users):
        for number in range(1, r.randint(2, 9)):
            order = len(orders)
            orders.append((order, user, number))
            basket = r.sample(range(15), r.randint(0, 5))
            lines += [(order, p, int(number > 1), k + 1) for k, p in enumerate(basket)]
    return orders, lines


def batch_of(order: tuple) -> int:
    """Three orders a batch, and users beyond 30 only ever in the first."""
    return 0 if order[1] >= 30 else (order[2] - 1) // 3


def files(folder: str) -> set[str]:
    return set(glob.glob(f"{folder}/*/part=*/*.parquet"))


@pytest.fixture(scope="module")
def tables(spark):
    orders, lines = made()
    return orders, spark.createDataFrame(orders, ORDERS), spark.createDataFrame(lines, LINES)


def whole(orders, lines):
    scored = X.interaction_features(orders, lines).select(
        "user_id", "product_id", F.col("up_order_rate").alias("reorder_probability")
    )
    return rows(ranked_pairs(scored))


def in_batch(spark, orders: list, number: int):
    return spark.createDataFrame([o for o in orders if batch_of(o) == number], ORDERS)


def test_increments_equal_a_recompute(spark, tables, tmp_path):
    orders, all_orders, lines = tables
    store = S.RankedStore(spark, f"{tmp_path}/store", parts=16)
    for b in range(3):
        before = files(store.folder)
        new = in_batch(spark, orders, b)
        written = store.apply(b, new, lines)
        touched = {r[0] for r in new.select(store._part()).distinct().collect()}
        assert set(written) == touched
        same = {f for f in before if int(f.split("part=")[1].split("/")[0]) not in touched}
        assert same <= files(store.folder)  # untouched parts keep their files
        known = spark.createDataFrame([o for o in orders if batch_of(o) <= b], ORDERS)
        assert rows(store.read("ranked").drop("as_of", "part")) == whole(known, lines)
    assert len(touched) < 16
    after = files(store.folder)
    assert store.apply(2, in_batch(spark, orders, 2), lines) == [] and files(store.folder) == after
    with pytest.raises(ValueError, match="comes after"):
        store.apply(-1, all_orders, lines)


def test_a_batch_cut_off_is_finished_once(spark, tables, tmp_path, monkeypatch):
    orders, all_orders, lines = tables
    store = S.RankedStore(spark, f"{tmp_path}/store", parts=4)
    store.apply(0, in_batch(spark, orders, 0), lines)

    def stop(*_):
        raise RuntimeError("lost")

    for step in ("_rank", "_merge"):
        with monkeypatch.context() as m:
            m.setattr(S.RankedStore, step, stop)
            with pytest.raises(RuntimeError):
                store.apply(1, in_batch(spark, orders, 1), lines)
    store.apply(1, in_batch(spark, orders, 1), lines)
    store.apply(2, in_batch(spark, orders, 2), lines)
    assert rows(store.read("ranked").drop("as_of", "part")) == whole(all_orders, lines)


def test_lookup_reads_few_files(spark, tables, tmp_path):
    _, orders, lines = tables
    store = S.RankedStore(spark, f"{tmp_path}/store", parts=64)
    store.apply(0, orders, lines)
    asked = spark.createDataFrame([(3,), (3,), (7,), (None,), (10**12,)], "user_id long")
    found = store.lookup(asked)
    expected = store.read("ranked").filter("user_id IN (3, 7)").drop("as_of", "part")
    assert rows(found) == rows(expected) and found.count() > 0
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "In(user_id" in plan
    read = {os.path.dirname(r[0]) for r in found.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= 3 <= 0.05 * 64
    many = store.lookup(spark.range(200).withColumnRenamed("id", "user_id"))
    assert rows(many) == rows(store.read("ranked").drop("as_of", "part"))


def test_empty_and_null_rows(spark, tmp_path):
    store = S.RankedStore(spark, f"{tmp_path}/store", parts=4)
    assert store.read("ranked").count() == 0 and store.lookup(spark.createDataFrame([(1,)], "user_id long")).count() == 0
    assert store.apply(0, spark.createDataFrame([], ORDERS), spark.createDataFrame([], LINES)) == []
    orders = spark.createDataFrame([(1, 5, 1), (2, None, 1)], ORDERS)
    lines = spark.createDataFrame([(1, 9, None, None), (1, None, 0, 1), (2, 9, 0, 1), (3, 9, 0, 1)], LINES)
    store.apply(1, orders, lines)
    assert rows(store.read("ranked").drop("as_of", "part")) == [(5, 9, 1.0, 1)]


def test_rows_of_a_batch_are_dealt_once(spark, tables, tmp_path, monkeypatch):
    """One exchange, by ranges, before rows are merged or ranked; nothing is joined."""
    orders, _, lines = tables
    store = S.RankedStore(spark, f"{tmp_path}/store", parts=4)
    plans = {}
    overwrite = S.RankedStore._overwrite

    def kept(self, name, rows):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        overwrite(self, name, rows)

    monkeypatch.setattr(S.RankedStore, "_overwrite", kept)
    for b in range(2):
        store.apply(b, in_batch(spark, orders, b), lines)
    for name, text in plans.items():
        assert text.count("Exchange") == text.count("Exchange rangepartitioning(part") == 1, name
        assert "Join" not in text
