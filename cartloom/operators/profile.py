"""Data profiling: shapes, quality, distributions, summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.functions.columns import day_name, ratio
from cartloom.functions.quantiles import exact_quantiles

#: Columns of a pass of ``_ranges``: five fields each (a mean has two).
STATISTICS = 16


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# --- shapes and quality ----------------------------------------------------------


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column count of each table."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in tables.items()
        ]
    )


def overview(orders: DataFrame) -> DataFrame:
    """Orders per evaluation set and distinct users, in one row."""

    def part(name: str) -> Column:
        return F.count(F.when(F.col("eval_set") == name, 1)).alias(f"{name}_orders")

    return orders.agg(
        F.count(F.lit(1)).alias("n_orders"),
        part("prior"),
        part("train"),
        part("test"),
        F.count_distinct("user_id").alias("n_users"),
    )


def missing_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count and percentage per column with nulls; a clean table reports one row
    with a null column name and 0."""
    reports = []
    for name, df in tables.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns],
        )
        entries = F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing"))
                for c in df.columns
            ]
        )
        bad = F.filter(entries, lambda e: e["n_missing"] > 0)
        clean = F.array(
            F.struct(
                F.lit(None).cast("string").alias("column_name"),
                F.lit(0).cast("long").alias("n_missing"),
            )
        )
        shown = F.when(F.size(bad) > 0, bad).otherwise(clean)
        reports.append(
            counts.select("total", F.explode(shown).alias("e")).select(
                F.lit(name).alias("table_name"),
                "e.column_name",
                "e.n_missing",
                (F.coalesce(ratio("e.n_missing", "total"), F.lit(0.0)) * 100).alias("pct_missing"),
            )
        )
    return _union(reports)


def first_order_quality(orders: DataFrame) -> DataFrame:
    """Missing gaps and how many of them are not on a user's first order."""
    null_gap = F.col("days_since_prior_order").isNull()
    return orders.agg(
        F.count(F.when(null_gap, 1)).alias("n_missing_gaps"),
        F.count(F.when(null_gap & (F.col("order_number") != 1), 1)).alias("n_violations"),
    )


def require_first_order_quality(orders: DataFrame) -> None:
    """Stop the job if a gap is missing on an order that is not the first."""
    bad = first_order_quality(orders).first()["n_violations"]
    if bad:
        raise ValueError(f"{bad} missing gaps are not first orders")


# --- distributions ---------------------------------------------------------------


def target_distribution(lines: DataFrame) -> DataFrame:
    """Reordered and new lines, counts and percentages."""
    return lines.agg(
        F.sum("reordered").alias("n_reordered"),
        F.count(F.when(F.col("reordered") == 0, 1)).alias("n_new"),
        (F.avg("reordered") * 100).alias("pct_reordered"),
        ((1 - F.avg("reordered")) * 100).alias("pct_new"),
    )


def _histogram(values: DataFrame) -> DataFrame:
    """Rows per value; the statistics below read this short list instead of the rows."""
    return values.toDF("v").filter(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("n")
    )


def _weighted_median() -> Column:
    # the histogram holds one entry per distinct count: at most sqrt(2 x rows) of them
    return F.percentile("v", F.lit(0.5), F.col("n")).alias("median")


def _weighted_mean() -> Column:
    return ratio(F.sum(F.col("v") * F.col("n")), F.sum("n"))


def orders_per_user_stats(prior_orders: DataFrame, many: int = 10) -> DataFrame:
    """Min, median and max orders per user and the share of users above ``many``."""
    per_user = prior_orders.groupBy("user_id").agg(F.count("order_id").alias("v"))
    h = _histogram(per_user.select("v"))
    return h.agg(
        F.min("v").alias("min_orders"),
        _weighted_median().alias("median_orders"),
        F.max("v").alias("max_orders"),
        (ratio(F.sum(F.when(F.col("v") > many, F.col("n")).otherwise(0)), F.sum("n")) * 100).alias(
            "pct_above"
        ),
    )


def orders_by_dow(orders: DataFrame) -> DataFrame:
    """Orders per day Sun..Sat (null for a day without orders), the top day marked."""
    spark = orders.sparkSession
    days = spark.range(7).select(F.col("id").cast("int").alias("order_dow"))
    counts = orders.groupBy("order_dow").agg(F.count(F.lit(1)).alias("n_orders"))
    top = counts.filter(F.col("order_dow").between(0, 6)).agg(
        F.max_by("order_dow", F.struct("n_orders", -F.col("order_dow"))).alias("top_dow")
    )
    return (
        days.join(counts, "order_dow", "left")
        .join(
            top.select(F.col("top_dow").alias("order_dow"), F.lit(True).alias("top")),
            "order_dow",
            "left",
        )
        .select(
            "order_dow",
            day_name(F.col("order_dow")).alias("day"),
            "n_orders",
            F.coalesce("top", F.lit(False)).alias("is_top_day"),
        )
        .orderBy("order_dow")
    )


def orders_by_hour(orders: DataFrame) -> DataFrame:
    """Orders per hour in order, the peak hour marked (earliest on a tie)."""
    counts = (
        orders.filter(F.col("order_hour_of_day").isNotNull())
        .groupBy("order_hour_of_day")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    peak = counts.agg(
        F.max_by("order_hour_of_day", F.struct("n_orders", -F.col("order_hour_of_day"))).alias("p")
    ).select(F.col("p").alias("order_hour_of_day"), F.lit(True).alias("peak"))
    return (
        counts.join(peak, "order_hour_of_day", "left")
        .select(
            "order_hour_of_day", "n_orders", F.coalesce("peak", F.lit(False)).alias("is_peak_hour")
        )
        .orderBy("order_hour_of_day")
    )


def order_gap_stats(prior_orders: DataFrame) -> DataFrame:
    """Mean, median, weekly (6-8) and monthly (28-30) share of the non-zero gaps."""
    gaps = prior_orders.select(F.nullif("days_since_prior_order", F.lit(0.0)).alias("v")).filter("v IS NOT NULL")
    seen = gaps.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    middle = exact_quantiles(gaps, {"v": (seen["n"], seen["low"], seen["high"])}, (0.5,)).get("v", [None])

    def share(low: int, high: int) -> Column:
        return ratio(F.count_if(F.col("v").between(low, high)), F.count("v")) * 100

    return gaps.agg(
        F.avg("v").alias("mean_gap"),
        F.lit(middle[0]).cast("double").alias("median_gap"),
        share(6, 8).alias("pct_weekly"),
        share(28, 30).alias("pct_monthly"),
    )


def orders_by_gap(orders: DataFrame) -> DataFrame:
    """Orders per gap value, missing gaps left out."""
    return (
        orders.filter(F.col("days_since_prior_order").isNotNull())
        .groupBy("days_since_prior_order")
        .agg(F.count(F.lit(1)).alias("n_orders"))
        .orderBy("days_since_prior_order")
    )


def _basket_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.count("product_id").alias("v")).select("v")


def basket_size_stats(lines: DataFrame) -> DataFrame:
    """Median, mean and max products per order."""
    return _histogram(_basket_sizes(lines)).agg(
        _weighted_median().alias("median_size"),
        _weighted_mean().alias("mean_size"),
        F.max("v").alias("max_size"),
    )


def basket_size_hist(lines: DataFrame, cap: int = 40, bins: int = 40) -> DataFrame:
    """Orders per equal-width basket-size bin after capping; the last bin is closed.

    Like the plotted histogram the bins span the capped minimum and maximum, and a
    single size is widened by half a unit on both sides.
    """
    h = _histogram(_basket_sizes(lines)).groupBy(
        F.least("v", F.lit(cap)).cast("double").alias("v")
    ).agg(F.sum("n").alias("n"))
    # one row: both ends and the at most ``cap`` capped sizes
    row = h.agg(
        F.min("v").alias("a"), F.max("v").alias("b"), F.collect_list(F.struct("v", "n")).alias("h")
    ).filter(F.col("a").isNotNull())
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    slots = row.select(
        (F.col("a") - half).alias("low"),
        (F.col("b") + half).alias("high"),
        "h",
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
    )
    low, high, this = F.col("low"), F.col("high"), F.col("bin")
    width = (high - low) / bins

    def here(e: Column) -> Column:
        return F.least(F.width_bucket(e["v"], low, high, F.lit(bins)), F.lit(bins)) == this

    return slots.select(
        "bin",
        (low + (this - 1) * width).alias("bin_low"),
        (low + this * width).alias("bin_high"),
        F.aggregate(
            F.filter("h", here), F.lit(0).cast("long"), lambda acc, e: acc + e["n"]
        ).alias("n_orders"),
    ).orderBy("bin")


def reorder_by_cart_position(lines: DataFrame, first: int = 20) -> DataFrame:
    """Reorder share of the first cart positions."""
    return (
        lines.groupBy("add_to_cart_order")
        .agg(F.avg("reordered").alias("reorder_rate"))
        .orderBy("add_to_cart_order")
        .limit(first)
    )


def reorder_at_positions(lines: DataFrame, positions: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Reorder share at given cart positions, 0 where a position never occurs."""
    row = lines.agg(
        *[
            F.coalesce(
                F.avg(F.when(F.col("add_to_cart_order") == p, F.col("reordered"))), F.lit(0.0)
            ).alias(f"p{p}")
            for p in positions
        ]
    )
    entries = [
        F.struct(F.lit(p).alias("add_to_cart_order"), F.col(f"p{p}").alias("reorder_rate"))
        for p in positions
    ]
    return row.select(F.inline(F.array(*entries)))


def department_totals(
    lines: DataFrame, products: DataFrame, departments: DataFrame
) -> DataFrame:
    """Lines and reorder share per department.

    Lines are summed per product before the join, so the join sees one row per product
    however popular it is.
    """
    by_product = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reordered").alias("r")
    )
    return (
        by_product.join(products.select("product_id", "department_id"), "product_id")
        .join(departments, "department_id")
        .groupBy("department")
        .agg(
            F.sum("n").alias("n_lines"),
            ratio(F.sum("r"), F.sum("n")).alias("reorder_rate"),
        )
    )


def department_volume(totals: DataFrame, first: int | None = None) -> DataFrame:
    """Departments by number of lines, largest first."""
    out = totals.select("department", "n_lines").orderBy(F.desc("n_lines"), "department")
    return out if first is None else out.limit(first)


def department_reorder(totals: DataFrame, first: int | None = None) -> DataFrame:
    """Departments by reorder share (3 digits), highest first."""
    out = totals.orderBy(F.desc("reorder_rate"), "department")
    out = out if first is None else out.limit(first)
    return out.select("department", F.round("reorder_rate", 3).alias("reorder_rate"))


# --- summaries -------------------------------------------------------------------

DESCRIBE_SCHEMA = (
    "table_name string, column_name string, n long, mean double, std double, "
    "min double, q25 double, q50 double, q75 double, max double"
)


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """Count, mean, std, min, quartiles and max of every numeric column.

    Returns one row per column, so the result is as long as the schemas are wide.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        columns = numeric_columns(df)
        if not columns:
            continue
        row = df.agg(
            *[
                F.struct(
                    F.count(c).alias("n"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                ).alias(c)
                for c in columns
            ]
        ).first()
        ranges = {c: (row[c]["n"], row[c]["min"], row[c]["max"]) for c in columns}
        quarters = exact_quantiles(df, ranges, (0.25, 0.5, 0.75))
        for c in columns:
            s = row[c]
            out.append((name, c, s["n"], s["mean"], s["std"], s["min"], *quarters[c], s["max"]))
    return spark.createDataFrame(out, DESCRIBE_SCHEMA)


def correlations(tables: dict[str, DataFrame]) -> DataFrame:
    """Pearson r of every pair of numeric, non-constant columns, in long form.

    Rows missing either value are left out pair by pair. Tables with fewer than two
    such columns give no rows. All sums of a table come from one Gram matrix, where one
    built-in ``corr`` per pair would need six buffers for each of several hundred pairs.
    """
    parts = [p for name, df in tables.items() if (p := _correlation(name, df)) is not None]
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_name string, x string, y string, r double")
    return _union(parts)


def _products(df: DataFrame, columns: list[str], means: list[float], gaps: list[int]) -> np.ndarray:
    """The Gram matrix of a vector per row: centred values (missing: 0), a 1 and, only where columns have ``gaps``,
    which of them are present and the squares of all values. Tasks multiply a batch of rows at a time; the square of
    at most 3k + 1 sums leaves each, and they are added up before they reach the driver."""
    width = len(columns) + 1 + (len(gaps) + len(columns) if gaps else 0)

    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = [c.fill_null(m).to_numpy(zero_copy_only=False) - m for c, m in zip(batch.columns, means)]
            entries = [*x, np.ones(batch.num_rows)]
            if gaps:
                entries += [batch.column(i).is_valid().to_numpy(zero_copy_only=False).astype(float) for i in gaps]
                entries += [v * v for v in x]
            rows = np.stack(entries)
            total += rows @ rows.T
        parts = [pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(parts, names=["at", "part"])

    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    total = np.zeros(width * width)
    for at, value in values.mapInArrow(multiply, "at int, part double").groupBy("at").agg(F.sum("part")).collect():
        total[at] = value
    return total.reshape(width, width)


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, Row]:
    """Mean ``m``, least ``a``, largest ``b`` and number ``n`` of the values of each column, and all ``rows``.

    A pass for ``STATISTICS`` columns, as Spark does not compile an aggregate of more than 100 fields."""
    found = {}
    for lo in range(0, len(columns), STATISTICS):
        some = columns[lo : lo + STATISTICS]
        of = [(F.avg, "m"), (F.min, "a"), (F.max, "b"), (F.count, "n")]
        sums = [f(c).alias(f"{name}{i}") for i, c in enumerate(some) for f, name in of]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
        for i, c in enumerate(some):
            found[c] = Row(rows=row["rows"], **{name: row[f"{name}{i}"] for _, name in of})
    return found


def _correlation(name: str, df: DataFrame) -> DataFrame | None:
    columns = numeric_columns(df)
    if not columns:
        return None
    seen = _ranges(df, columns)
    columns = [c for c in columns if seen[c]["a"] is not None and seen[c]["a"] != seen[c]["b"]]
    if len(columns) < 2:
        return None
    k = len(columns)
    gaps = [i for i, c in enumerate(columns) if seen[c]["n"] < seen[c]["rows"]]
    gram = _products(df, columns, [float(seen[c]["m"]) for c in columns], gaps)
    # the 1 stands for the presence of a column without gaps
    mask = [k + 1 + gaps.index(j) if j in gaps else k for j in range(k)]
    sxy, sx, n = gram[:k, :k], gram[:k, mask], gram[np.ix_(mask, mask)]
    sxx = np.repeat(np.diag(sxy)[:, None], k, axis=1)
    for j in gaps:
        sxx[:, j] = gram[k + 1 + len(gaps) :, mask[j]]
    out = []
    for i in range(k):
        for j in range(i, k):
            m = n[i, j]
            r = None
            if m:
                spread = max(sxx[i, j] - sx[i, j] ** 2 / m, 0.0) * max(sxx[j, i] - sx[j, i] ** 2 / m, 0.0)
                r = float((sxy[i, j] - sx[i, j] * sx[j, i] / m) / spread**0.5) if spread > 0 else None
            out.append((name, columns[i], columns[j], r))
            if i != j:
                out.append((name, columns[j], columns[i], r))
    return df.sparkSession.createDataFrame(out, "table_name string, x string, y string, r double")


# --- feature catalogue -----------------------------------------------------------

# table, feature, type, method, meaning
FEATURES: tuple[tuple[str, str, str, str, str], ...] = (
    ("orders", "is_first_order", "Binary", "Derived", "whether the order is the user's first"),
    ("user_feat", "user_total_orders", "Count", "Aggregated", "past orders of the user"),
    ("user_feat", "user_avg_days_between", "Float", "Aggregated", "mean gap in days"),
    ("user_feat", "user_std_days_between", "Float", "Aggregated", "spread of the gap"),
    ("user_feat", "user_min_days_between", "Float", "Aggregated", "shortest gap"),
    ("user_feat", "user_max_days_between", "Float", "Aggregated", "longest gap"),
    ("user_feat", "user_avg_order_hour", "Float", "Aggregated", "mean hour of ordering"),
    ("user_feat", "user_std_order_hour", "Float", "Aggregated", "spread of the hour"),
    ("user_feat", "user_total_products", "Count", "Aggregated", "lines over all past orders"),
    ("user_feat", "user_unique_products", "Count", "Aggregated", "different products bought"),
    ("user_feat", "user_total_reorders", "Count", "Aggregated", "lines that were repeats"),
    ("user_feat", "user_reorder_rate", "Rate", "Derived", "repeats per line"),
    ("user_feat", "user_avg_basket_size", "Float", "Derived", "lines per order"),
    ("prod_feat", "product_total_orders", "Count", "Aggregated", "lines with the product"),
    ("prod_feat", "product_reorder_rate", "Rate", "Aggregated", "repeats per line"),
    ("prod_feat", "product_avg_cart_pos", "Float", "Aggregated", "mean cart position"),
    ("prod_feat", "product_std_cart_pos", "Float", "Aggregated", "spread of the position"),
    ("prod_feat", "product_unique_users", "Count", "Aggregated", "users who bought it"),
    ("prod_feat", "dept_avg_reorder_rate", "Rate", "Derived", "mean rate in its department"),
    ("prod_feat", "aisle_avg_reorder_rate", "Rate", "Derived", "mean rate in its aisle"),
    ("up_feat", "up_times_ordered", "Count", "Aggregated", "purchases by the user"),
    ("up_feat", "up_reorder_count", "Count", "Aggregated", "repeat purchases by the user"),
    ("up_feat", "up_avg_cart_position", "Float", "Aggregated", "mean position in their carts"),
    ("up_feat", "up_first_order_number", "Int", "Aggregated", "order of the first purchase"),
    ("up_feat", "up_last_order_number", "Int", "Aggregated", "order of the last purchase"),
    ("up_feat", "up_reorder_rate", "Rate", "Derived", "repeats per purchase"),
    ("up_feat", "up_orders_span", "Int", "Derived", "orders from first to last purchase"),
    ("up_feat", "up_buy_frequency", "Float", "Derived", "purchases per order of the span"),
    ("up_feat", "up_orders_since_last", "Int", "Derived", "orders since the last purchase"),
    ("up_feat", "up_recency_score", "Float", "Derived", "decays with orders since"),
)


def feature_catalogue(engineered: dict[str, DataFrame]) -> DataFrame:
    """The engineered features with how full and how wide-ranging each one is.

    ``engineered`` maps the table names of ``FEATURES`` to the computed tables; each is
    read once and gives one row per feature.
    """
    parts = []
    for table, df in engineered.items():
        listed = [f for f in FEATURES if f[0] == table]
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(f[1]).alias(f"{f[1]}_n") for f in listed],
            *[F.min(f[1]).cast("double").alias(f"{f[1]}_lo") for f in listed],
            *[F.max(f[1]).cast("double").alias(f"{f[1]}_hi") for f in listed],
        )
        entries = [
            F.struct(
                *[
                    F.lit(v).alias(k)
                    for k, v in zip(
                        ("table_name", "feature", "kind", "method", "description"), f, strict=True
                    )
                ],
                F.col("n_rows").alias("n_rows"),
                F.col(f"{f[1]}_n").alias("n_present"),
                F.col(f"{f[1]}_lo").alias("min_value"),
                F.col(f"{f[1]}_hi").alias("max_value"),
            )
            for f in listed
        ]
        parts.append(row.select(F.inline(F.array(*entries))))
    return _union(parts)


def catalogue_counts(catalogue: DataFrame, by: str) -> DataFrame:
    """Features per ``table_name`` or ``method``, most first."""
    return catalogue.groupBy(by).agg(F.count(F.lit(1)).alias("n_features")).orderBy(
        F.desc("n_features"), by
    )


