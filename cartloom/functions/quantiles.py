"""Exact order statistics of many columns without gathering any column.

Spark's exact ``percentile`` keeps every distinct value of a column in one task. Here
each wanted rank is located by narrowing: one aggregate counts rows per equal slice of
the current value range, the slice that holds the rank becomes the next range, until it
holds a single value. Every pass is a map-side combined group-by with a bounded result
(wanted ranks x slices), whatever the number of rows or distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 1024
#: Of a search of a column that has many.
LEAST_SLICES = 128
# Enough passes to narrow the whole range of doubles 1024-fold at a time.
MAX_PASSES = 256


def quantile_ranks(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """0-based lower and upper rank and the weight of the upper one, linear rule."""
    out = []
    for p in probs:
        at = (n - 1) * p
        lo = math.floor(at)
        out.append((lo, min(lo + 1, n - 1), at - lo))
    return out


def exact_quantiles(
    df: DataFrame, ranges: dict[str, tuple[int, float, float]], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles per column by linear interpolation.

    ``ranges`` gives (non-null count, min, max) of each column, as from one aggregate.
    """
    ranks = {c: [r for lo, hi, _ in quantile_ranks(n, probs) for r in (lo, hi)] for c, (n, _, _) in ranges.items() if n}
    wanted = values_at_ranks(df, ranges, ranks)
    out: dict[str, list[float | None]] = {}
    for column, (n, _, _) in ranges.items():
        if not n:
            out[column] = [None] * len(probs)
            continue
        found = wanted[column]
        out[column] = [
            found[lo] + (found[hi] - found[lo]) * w for lo, hi, w in quantile_ranks(n, probs)
        ]
    return out


def values_at_ranks(
    df: DataFrame, ranges: dict[str, tuple[int, float, float]], ranks: dict[str, Sequence[int]]
) -> dict[str, dict[int, float | None]]:
    """The value of each column at 0-based ranks of its ascending non-null values."""
    wanted: dict[str, dict[int, float | None]] = {}
    # open searches: (column, low, high, rows below low) -> ranks inside the range
    open_: dict[tuple[str, float, float, int], list[int]] = {}
    for column, asked in ranks.items():
        _, low, high = ranges[column]
        asked = sorted(set(asked))
        wanted[column] = dict.fromkeys(asked)
        if low == high:
            wanted[column] = dict.fromkeys(asked, low)
        else:
            open_[(column, low, high, 0)] = asked

    for _ in range(MAX_PASSES):
        if not open_:
            break
        open_ = _narrow(df, open_, wanted)
    if open_:
        raise RuntimeError(f"quantile search did not settle for {sorted(k[0] for k in open_)}")
    return wanted


def _narrow(df, open_, wanted):
    """One pass for all open searches. Those of a column lie in disjoint ranges, so a value is looked up in
    one sorted list of all their slices, however many searches there are."""
    by_column: dict[str, list[tuple[float, float, int]]] = {}
    for column, low, high, below in sorted(open_, key=lambda search: search[1]):
        by_column.setdefault(column, []).append((low, high, below))
    splits, owners = [], []
    for searches in by_column.values():
        parts = min(SLICES, max(LEAST_SLICES, 4 * SLICES // len(searches)))
        edges, owner = [float("-inf")], [None]
        for search in searches:
            low, high, _ = search
            step = high / parts - low / parts
            inner = sorted({e for k in range(1, parts) if low < (e := low + k * step) < high})
            # a slice ends before the next one begins, the last one with ``high``
            if edges[-1] == low:  # right above the range before
                edges.pop(), owner.pop()
            edges += [low, *inner, high, math.nextafter(high, math.inf)]
            owner += [search] * (len(edges) - 1 - len(owner)) + [None]
        splits.append([*edges, float("inf")])
        owners.append(owner)
    names = list(by_column)
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    placed = Bucketizer(
        splitsArray=splits,
        inputCols=[f"v{i}" for i in range(len(names))],
        outputCols=[f"p{i}" for i in range(len(names))],
        handleInvalid="keep",
    ).transform(values)
    picks = []
    for i, searches in enumerate(by_column.values()):
        inside = F.col(f"v{i}").between(searches[0][0], searches[-1][1])
        picks.append(
            F.when(inside, F.struct(F.lit(i).alias("i"), F.col(f"p{i}").cast("int").alias("part"), F.col(f"v{i}").alias("v")))
        )
    rows = (
        placed.select(F.explode(F.array(*picks)).alias("x"))
        .filter(F.col("x").isNotNull())
        .groupBy("x.i", "x.part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
        .collect()  # at most slices of all searches rows
    )
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["part"])):
        search = owners[r["i"]][r["part"]]
        if search:
            found.setdefault((names[r["i"]], *search), []).append(r)
    following: dict[tuple[str, float, float, int], list[int]] = {}
    for search, ranks in open_.items():
        column, _, _, below = search
        for row in found.get(search, []):
            inside = [r for r in ranks if below <= r < below + row["n"]]
            if inside and row["lo"] == row["hi"]:
                wanted[column].update(dict.fromkeys(inside, row["lo"]))
            elif inside:
                following[(column, row["lo"], row["hi"], below)] = inside
            below += row["n"]
    return following
