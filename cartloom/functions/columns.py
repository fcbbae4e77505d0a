"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names by day number, 0 = Sunday.
DAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as a double; null when the denominator is 0 or null."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(num.cast("double"), den.cast("double"))


def std_from_sums(n: str, total: str, squares: str) -> Column:
    """Sample standard deviation from a count, a sum and a sum of squares; 0 for n = 1."""
    n_, s, q = (F.col(c).cast("double") for c in (n, total, squares))
    var = F.greatest(q - F.try_divide(s * s, n_), F.lit(0.0))
    return F.coalesce(F.sqrt(F.try_divide(var, n_ - 1)), F.lit(0.0))


def day_name(day: Column) -> Column:
    """Day number (0 = Sunday) to its short name; null outside 0-6."""
    pairs = [x for i, name in enumerate(DAY_NAMES) for x in (F.lit(i), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), day)


def hash_key(*columns: str, seed: int = 42) -> Column:
    """Hex digest of the key columns and a seed: a repeatable random order."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def hash_percent(*columns: str, seed: int = 42) -> Column:
    """Repeatable number 0-99 per key."""
    head = F.substring(hash_key(*columns, seed=seed), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % 100).cast("int")


def same_within(left: str, right: str) -> Column:
    """Whether two columns of a join are equal, as a condition on rows that its key has brought together:
    unlike ``==`` it is no key, so sides that lie by the key alone are not dealt again."""
    return F.col(left).between(F.col(right), F.col(right))
