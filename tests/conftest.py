from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartloom.schemas import AISLES, DEPARTMENTS, ORDER_PRODUCTS, ORDERS, PRODUCTS
from cartloom.session import session
from cartloom.sources.tables import Tables


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


class Shop:
    """Hand-made rows in the six-table layout.

    User 1: three prior orders and a train order. User 2: one prior order and a test
    order. User 3: a single order, without lines. User 4: prior lines, train order with
    new products only. Product 50 is bought but not listed; product 60 never bought.
    """

    def __init__(self, spark):
        self.orders = spark.createDataFrame(
            [
                (1, 1, "prior", 1, 0, 8, None),
                (2, 1, "prior", 2, 1, 9, 7.0),
                (3, 1, "prior", 3, 6, 23, 0.0),
                (4, 1, "train", 4, 2, 10, 30.0),
                (5, 2, "prior", 1, 0, 8, None),
                (6, 2, "test", 2, 3, 12, 6.0),
                (7, 3, "prior", 1, 4, 0, None),
                (8, 4, "prior", 1, 5, 5, None),
                (9, 4, "train", 2, 5, 6, 28.0),
            ],
            ORDERS,
        )
        self.prior = spark.createDataFrame(
            [
                (1, 10, 1, 0),
                (1, 20, 2, 0),
                (2, 10, 1, 1),
                (2, 30, 2, 0),
                (2, 50, 3, 0),
                (3, 10, 2, 1),
                (3, 20, 1, 1),
                (5, 10, 1, 0),
                (5, 40, 2, 0),
                (8, 20, 1, 0),
            ],
            ORDER_PRODUCTS,
        )
        self.train = spark.createDataFrame(
            [(4, 10, 1, 1), (4, 40, 2, 0), (4, 20, 3, 1), (9, 30, 1, 0)], ORDER_PRODUCTS
        )
        self.products = spark.createDataFrame(
            [
                (10, "Red Apple", 1, 1),
                (20, "green apple, \"large\"", 1, 1),
                (30, "Bread", 2, 2),
                (40, None, 2, 2),
                (60, "Unsold", 2, 2),
            ],
            PRODUCTS,
        )
        self.aisles = spark.createDataFrame([(1, "fruit"), (2, "bakery")], AISLES)
        self.departments = spark.createDataFrame([(1, "fresh"), (2, "dry")], DEPARTMENTS)

    @property
    def tables(self):
        return Tables(
            self.orders, self.prior, self.train, self.products, self.aisles, self.departments
        )

    def named(self):
        return self.tables.named()

    @property
    def prior_orders(self):
        return self.orders.filter("eval_set = 'prior'")


@pytest.fixture(scope="session")
def shop(spark):
    return Shop(spark)


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, v) for v in t])


def keyed(df, *keys):
    """Row dicts by key tuple (or plain value for one key)."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        k = tuple(d[x] for x in keys)
        k = k[0] if len(keys) == 1 else k
        assert k not in out, f"duplicate key {k}"
        out[k] = d
    return out
