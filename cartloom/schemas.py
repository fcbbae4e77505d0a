"""Declared schemas of the input tables and of the scoring request."""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("eval_set", T.StringType()),
        T.StructField("order_number", T.IntegerType()),
        T.StructField("order_dow", T.IntegerType()),
        T.StructField("order_hour_of_day", T.IntegerType()),
        T.StructField("days_since_prior_order", T.DoubleType()),
    ]
)

ORDER_PRODUCTS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("add_to_cart_order", T.IntegerType()),
        T.StructField("reordered", T.IntegerType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("aisle_id", T.IntegerType()),
        T.StructField("department_id", T.IntegerType()),
    ]
)

AISLES = T.StructType(
    [T.StructField("aisle_id", T.IntegerType()), T.StructField("aisle", T.StringType())]
)

DEPARTMENTS = T.StructType(
    [
        T.StructField("department_id", T.IntegerType()),
        T.StructField("department", T.StringType()),
    ]
)

TABLES: dict[str, T.StructType] = {
    "orders": ORDERS,
    "order_products__prior": ORDER_PRODUCTS,
    "order_products__train": ORDER_PRODUCTS,
    "products": PRODUCTS,
    "aisles": AISLES,
    "departments": DEPARTMENTS,
}

# Column(s) that order a table's rows; a row limit follows them.
ROW_ORDER: dict[str, list[str]] = {
    "orders": ["order_id"],
    "order_products__prior": ["order_id", "product_id"],
    "order_products__train": ["order_id", "product_id"],
    "products": ["product_id"],
    "aisles": ["aisle_id"],
    "departments": ["department_id"],
}

KEY_COLUMNS = ("user_id", "product_id", "order_id", "reordered")
