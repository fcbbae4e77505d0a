"""Near duplicates by 64-bit SimHash fingerprints and vantage-point trees.

A vantage-point tree splits fingerprints by their Hamming distance to a vantage point, at the
median. By the triangle inequality a fingerprint within ``RADIUS`` of the other side's
members lies within ``RADIUS`` of the border, so only those are shown to the other side, as
guests. Two fingerprints of 64 bits that have nothing in common lie about 32 bits apart, as
far as the vantage point: near the median, where a plain tree prunes little. So there are
four trees and the root of each splits by a quarter of the bits: its children are the rings at
masked distance zero around every value. Fingerprints at most 3 bits apart agree in one
quarter at least, so each link is found in one of the trees, and no root needs guests.
Below the roots, every node above ``leaf`` fingerprints is split at the median distance from
its vantage point, as Spark jobs over all such nodes at once; leaves are searched in tasks by
trees of the same kind.

Only distinct fingerprints enter the trees. A leaf reports the components of its links, one row
per fingerprint, not all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import staged
from cartloom.llm.components import components

RADIUS = 3
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of a text: A-Z in lower case, shingles of ``words`` words
    joined by a space (fewer words: the whole sequence; none: zero), a bit set where more than
    half of the shingles' XXH64 have it."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` of every row; null texts count as empty."""

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            made = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=[key, "fp"])

    source = docs.select(key, F.col(text).alias("__text"))
    return source.mapInArrow(run, docs.select(key, F.lit(0).cast("long").alias("fp")).schema)


def links(fps: DataFrame, leaf: int = 4096) -> DataFrame:
    """``a``, ``b``: links whose components are those of all links between the distinct
    ``fp`` of ``fps`` at ``RADIUS`` or fewer differing bits."""
    quarter = F.expr("shiftrightunsigned(fp, 16 * tree) & 65535")
    trees = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("tree"))
    rows = trees.select("fp", (F.col("tree") * 65536 + quarter).alias("root"), F.lit(1).cast("long").alias("path"), F.lit(True).alias("home"))
    ready = None
    for _ in range(40):
        sizes = rows.filter("home").groupBy("root", "path").count().filter(F.col("count") > leaf)
        large = staged(sizes, "large-nodes")
        if large.isEmpty():
            break
        split, rest = _split(staged(rows, "nodes"), large)
        ready = rest if ready is None else ready.unionByName(rest)
        rows = staged(split, "nodes")
    rows = rows if ready is None else ready.unionByName(rows)
    nodes = rows.groupBy("root", "path").agg(
        F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("own"),
        F.collect_list(F.when(~F.col("home"), F.col("fp"))).alias("guests"),
    )
    nodes = nodes.filter("size(own) > 1 OR size(own) = 1 AND size(guests) > 0").select("own", "guests")

    def search(parts):
        import pyarrow as pa

        for batch in parts:
            a, b = [], []
            for own, guests in zip(batch.column(0), batch.column(1)):
                for x, y in leaf_links(own.as_py(), guests.as_py()):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return nodes.mapInArrow(search, "a long, b long")


def _split(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The children of the ``large`` nodes, and the rows of the others."""
    node = ["root", "path"]
    rest = rows.join(large, node, "left_anti")
    inside = rows.join(large.select(*node), node)
    own = inside.filter("home")
    vantage = own.groupBy(*node).agg(F.min_by("fp", F.xxhash64("fp", "path")).alias("vantage"))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).alias("d")
    median = own.join(vantage, node).groupBy(*node).agg(
        F.first("vantage").alias("vantage"), F.percentile_approx(away, 0.5, 1000).alias("median"), F.max(away).alias("most")
    )
    # the inner side must not be the whole node
    median = median.select(*node, "vantage", F.least("median", F.col("most") - 1).alias("median"))
    d = inside.join(median, node).select("fp", *node, "home", away, "median")
    inner, outer = F.col("path") * 2, F.col("path") * 2 + 1
    places = F.array_compact(
        F.array(
            F.when(F.col("home"), F.struct(F.when(F.expr("d <= median"), inner).otherwise(outer).alias("path"), F.lit(True).alias("home"))),
            # links over the border are found on the inner side
            F.when(F.expr(f"d <= median + {RADIUS} AND NOT (home AND d <= median)"), F.struct(inner.alias("path"), F.lit(False).alias("home"))),
            F.when(F.expr(f"NOT home AND d > median - {RADIUS}"), F.struct(outer.alias("path"), F.lit(False).alias("home"))),
        )
    )
    return d.select("fp", "root", F.inline(places)).select("fp", "root", "path", "home"), rest


def leaf_links(own: list[int], guests: list[int]) -> list[tuple[int, int]]:
    """Links whose components are those of all links within ``own`` and from it to ``guests``."""
    n = len(own)
    if n + len(guests) <= 8:
        everyone = own + guests
        return [
            (own[i], everyone[j])
            for i in range(n)
            for j in range(i + 1, len(everyone))
            if ((own[i] ^ everyone[j]) & (2**64 - 1)).bit_count() <= RADIUS
        ]
    fps = np.array([*own, *guests], np.int64).view(np.uint64)
    label = np.arange(len(fps))

    def join(x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label[label] != label).any():
                label[:] = label[label]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]

    def search(home: np.ndarray, near: np.ndarray, depth: int = 0) -> None:
        size = len(home) + len(near)
        if len(home) > 256 and depth < 24:
            d = np.bitwise_count(fps[home] ^ fps[home[depth % len(home)]])
            middle = np.minimum(np.median(d), d.max() - 1)
            g = np.bitwise_count(fps[near] ^ fps[home[depth % len(home)]])
            inner, border = d <= middle, (d > middle) & (d <= middle + RADIUS)
            shown = np.concatenate((home[border], near[g <= middle + RADIUS]))
            out = near[g > middle - RADIUS]
            if max(inner.sum() + len(shown), (~inner).sum() + len(out)) < 0.9 * size:
                search(home[inner], shown, depth + 1)
                search(home[~inner], out, depth + 1)
                return
        everyone = np.concatenate((home, near))
        for lo in range(0, len(home), 256):
            rows = home[lo : lo + 256]
            i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[everyone[lo:]][None, :]) <= RADIUS)
            join(rows[i], everyone[lo:][j])

    search(np.arange(n), np.arange(n, len(fps)))
    values = fps.view(np.int64).tolist()
    return [(values[i], values[r]) for i, r in enumerate(label.tolist()) if i != r]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf: int = 4096) -> DataFrame:
    """``key``, fingerprint (16 hex digits), component_id (the smallest key that links lead
    to), group_size (rows of the component) for every row.

    Null and empty texts have fingerprint zero and link like any other; repeated rows are
    members like others; an empty table gives an empty one.
    """
    rows = staged(fingerprints(docs, key, text), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "classes")
    joined = components(links(classes.select("fp"), leaf))
    named = classes.join(joined.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "named")
    whole = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    of_class = named.join(whole, "root").select("fp", "component_id", "group_size")
    return rows.join(of_class, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )
