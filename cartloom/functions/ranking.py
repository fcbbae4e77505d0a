"""Row numbers and top-k within groups that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.sources.stage import shared_folder

# A group above this many rows is numbered in slices instead of in one task.
GROUP_ROWS = 1 << 20


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``.

    ``row_number() <= k`` lets Spark cut each group to k rows in every map task before
    the shuffle, so a hot group sends k rows per task, not all its rows.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def number_sequence(
    df: DataFrame, group: str, when: str, unique: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Place each row in its group's sequence by (``when``, ``unique``).

    ``unique`` is an integer id that no two rows of a group share. Adds ``position``
    (1 = first), ``previous`` (``when`` of the row before, null on the first) and
    ``is_last``. Groups up to ``group_rows`` are numbered by one window. Larger ones,
    at most count/group_rows many, are numbered slice by slice: a slice is one value
    of ``when`` and one block of ids, so it holds no more than ``group_rows`` rows,
    and prefix sums over the slice counts turn local numbers into positions.
    """
    hot = df.groupBy(group).count().filter(F.col("count") > group_rows).select(group)
    hot = hot.persist()
    try:
        found = not hot.isEmpty()
        if not found:
            return _by_window(df, group, when, unique)
        # at most count(df) / group_rows keys, so small next to what it is joined with
        keys = F.broadcast(hot)
        small = _by_window(df.join(keys, group, "left_anti"), group, when, unique)
        large = _by_slices(df.join(keys, group, "left_semi"), group, when, unique, group_rows)
        return small.unionByName(large)
    finally:
        hot.unpersist()


def _by_window(df: DataFrame, group: str, when: str, unique: str) -> DataFrame:
    ordered = Window.partitionBy(group).orderBy(when, unique)
    return df.withColumns(
        {
            "position": F.row_number().over(ordered).cast("long"),
            "previous": F.lag(when).over(ordered),
            "is_last": F.lead(unique).over(ordered).isNull(),
        }
    )


def _by_slices(
    df: DataFrame, group: str, when: str, unique: str, slice_rows: int
) -> DataFrame:
    cut = df.withColumn("_block", F.floor(F.col(unique) / F.lit(slice_rows)))
    slices = cut.groupBy(group, when, "_block").agg(F.count(F.lit(1)).alias("_n"))
    steps = slices.groupBy(group, when).agg(F.sum("_n").alias("_step_n"))

    in_group = Window.partitionBy(group).orderBy(when)
    steps = steps.withColumns(
        {
            "_before_step": F.coalesce(
                F.sum("_step_n").over(in_group.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "_previous_step": F.lag(when).over(in_group),
            "_total": F.sum("_step_n").over(Window.partitionBy(group)),
        }
    )
    in_step = Window.partitionBy(group, when).orderBy("_block")
    slices = slices.withColumn(
        "_before_slice",
        F.coalesce(
            F.sum("_n").over(in_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    offsets = slices.join(steps, [group, when]).select(
        group, when, "_block", "_before_step", "_before_slice", "_previous_step", "_total"
    )
    local = Window.partitionBy(group, when, "_block").orderBy(unique)
    in_this_step = F.col("_before_slice") + F.row_number().over(local)
    return (
        cut.join(offsets, [group, when, "_block"])
        .withColumn("_in_step", in_this_step)
        .withColumns(
            {
                "position": (F.col("_before_step") + F.col("_in_step")).cast("long"),
                "previous": F.when(F.col("_in_step") == 1, F.col("_previous_step")).otherwise(
                    F.col(when)
                ),
                "is_last": F.col("_before_step") + F.col("_in_step") == F.col("_total"),
            }
        )
        .select(*df.columns, "position", "previous", "is_last")
    )


def dense_numbers(df: DataFrame, value: str, number: str, slices: int = 64) -> DataFrame:
    """The distinct non-null values of a column, numbered from 1 in ascending order.

    Values are numbered within ranges, and ranges follow each other by their counts, so no
    task holds all of them; the counts of at most ``slices`` ranges reach the driver.
    """
    distinct = df.select(value).filter(F.col(value).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(slices, value).withColumn("_slice", F.spark_partition_id())
    shared_folder(df.sparkSession)
    ranged = ranged.checkpoint()  # the ranges come from a sample, so they are fixed once
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_slice").count().collect()):
        starts.append((r["_slice"], before))
        before += r["count"]
    offset = F.lit(0)
    for piece, start in starts:
        offset = F.when(F.col("_slice") == piece, start).otherwise(offset)
    inside = Window.partitionBy("_slice").orderBy(value)
    return ranged.select((F.row_number().over(inside) + offset).alias(number), value)
