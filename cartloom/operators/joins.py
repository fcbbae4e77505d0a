"""Join operators: order history, dimension look-ups, semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A dimension is broadcast only if counting shows at most this many rows and, since texts
# may be long, this many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20
SALTS = 32

HISTORY_COLUMNS = (
    "order_id",
    "user_id",
    "order_number",
    "order_dow",
    "order_hour_of_day",
    "days_since_prior_order",
)


def attach(
    big: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a dimension to a large table whose key may be very uneven.

    The dimension is measured (up to ``max_rows``); if it fits it is broadcast and the
    large table does not move. Otherwise both sides are shuffled with a salt taken
    from ``spread`` (columns that differ within a key), the dimension once per salt,
    so that rows of one popular key end up in many tasks. Give a dimension that is
    cheap to count: a source or staged table.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if _fits(dim, max_rows):
        return big.join(F.broadcast(dim), keys, how)
    return salted_join(big, dim, keys, how, spread or [c for c in big.columns if c not in keys])


def _fits(dim: DataFrame, max_rows: int) -> bool:
    texts = [f.name for f in dim.schema if isinstance(f.dataType, StringType)]
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(dim.columns)))
    seen = dim.select(length.alias("size")).limit(max_rows + 1)
    found = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return found["n"] <= max_rows and found["size"] <= BROADCAST_BYTES


def salted_join(
    big: DataFrame, dim: DataFrame, keys: Sequence[str], how: str, spread: Sequence[str]
) -> DataFrame:
    """Equi-join with the large side's keys split over ``SALTS`` sub-keys."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        big.withColumn("_salt", salt)
        .join(dim.withColumn("_salt", copies), [*keys, "_salt"], how)
        .drop("_salt")
    )


def order_history(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Order lines with their order's user, sequence number, day, hour and gap."""
    return lines.join(orders.select(*HISTORY_COLUMNS), "order_id")


def lines_with_department(
    lines: DataFrame,
    products: DataFrame,
    departments: DataFrame,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Order lines with the department of their product."""
    names = products.select("product_id", "department_id").join(departments, "department_id")
    dim = names.select("product_id", "department")
    return attach(lines, dim, "product_id", spread=["order_id"], max_rows=max_rows)


def catalogue(products: DataFrame, departments: DataFrame, aisles: DataFrame) -> DataFrame:
    """Products with department and aisle names."""
    return (
        products.join(departments, "department_id")
        .join(aisles, "aisle_id")
        .select(
            "product_id", "product_name", "aisle_id", "department_id", "department", "aisle"
        )
    )


def history_of(
    users: DataFrame, orders: DataFrame, lines: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Orders of the given users and the lines of those orders (semi joins)."""
    chosen = orders.join(users.select("user_id"), "user_id", "left_semi")
    return chosen, lines.join(chosen.select("order_id"), "order_id", "left_semi")


def users_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct users having at least one order line.

    The lines' order ids are made distinct in the map tasks before they move.
    """
    return (
        orders.select("order_id", "user_id")
        .join(lines.select("order_id").distinct(), "order_id", "left_semi")
        .select("user_id")
        .distinct()
    )


def users_without_history(
    requested: DataFrame, orders: DataFrame, lines: DataFrame
) -> DataFrame:
    """Requested users that have no order or no line."""
    return requested.select("user_id").join(
        users_with_lines(orders, lines), "user_id", "left_anti"
    )
