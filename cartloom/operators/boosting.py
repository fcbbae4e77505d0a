"""Second-order gradient boosting of trees for a binary label.

Each round fits one tree to the first and second derivative of the logistic loss: a split's gain is the
regularised ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``, a leaf's weight the Newton step
``-G/(H+l2)``. Features are cut at exact quantiles once.

A level of a tree is one Spark job: tasks add up gradients and Hessians per node, feature and bin of their
rows, the partial sums are combined (in a tree of tasks where there are many), and the sums, whose number is
bounded by nodes x features x bins, decide the splits. Derivatives are rounded to multiples of 2^-24 and
added as whole numbers, so the sums, and with them the trees, do not depend on how rows are partitioned. For
the same reason only the lighter child of a split is summed over rows, and the other is its parent less that one.

Rows lie in blocks of at most ``BLOCK`` rows as bytes (one a feature), a label and a margin each. A fit
is a thousand short jobs over the same blocks, each with a few numpy calls a block, so the loop runs on the
blocks' RDD: a job without a plan takes a third of the time. Each round's margins are kept in memory or on
disk; every ``KEEP_ROUNDS`` rounds they are written to the shared folder, which ends the lineage. So a lost
executor costs a few rounds' margins of its blocks, and the last round costs what the first did.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions.quantiles import values_at_ranks
from cartloom.operators.models import align
from cartloom.schemas import KEY_COLUMNS
from cartloom.sources.stage import scratch_path

BLOCK = 1 << 15
KEEP_ROUNDS = 25
#: Tasks whose sums the driver adds itself; those of more are combined in tasks first.
DIRECT = 64
#: Derivatives are whole multiples of 1 / SCALE; 2^39 rows fit a sum.
SCALE = 1 << 24

BLOCKS = "n int, bins binary, labels binary, margins binary"


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as arrays of (round, node); the children of node ``i`` are ``2 i + 1`` (value at most
    ``cut``) and ``2 i + 2``. ``feature`` is -1 where a node is not split, and ``weight`` is
    what a row that ends there adds to the margin."""

    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.feature.shape[1] + 1)) - 1

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Of rows of feature values."""
        out = np.zeros(len(values))
        rows = np.arange(len(values))
        for feature, cut, weight in zip(self.feature, self.cut, self.weight):
            node = np.zeros(len(values), np.int64)
            for _ in range(self.depth):
                split = feature[node]
                right = values[rows, np.maximum(split, 0)] > cut[node]
                node = np.where(split >= 0, 2 * node + 1 + right, node)
            out += weight[node]
        return out

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row per node that rows can reach: round, node, feature and cut (null: a leaf), gain, weight."""
        rows = []
        for r, feature in enumerate(self.feature):
            reached = [0]
            for i in reached:
                split = feature[i] >= 0
                reached += [2 * i + 1, 2 * i + 2] if split else []
                name = self.features[feature[i]] if split else None
                cut, gain = (float(self.cut[r, i]), float(self.gain[r, i])) if split else (None, None)
                rows.append((r, int(i), name, cut, gain, None if split else float(self.weight[r, i])))
        return spark.createDataFrame(rows, "round int, node int, feature string, cut double, gain double, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        whole = {
            "features": self.features,
            "feature": self.feature.tolist(),
            "cut": self.cut.tolist(),
            "weight": self.weight.tolist(),
            "gain": self.gain.tolist(),
        }
        # one row: its size is bounded by rounds and depth
        spark.createDataFrame([(json.dumps(whole),)], "trees string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        whole = json.loads(spark.read.parquet(path).first()[0])
        arrays = {k: np.array(whole[k], np.int64 if k == "feature" else float) for k in ("feature", "cut", "weight", "gain")}
        return BoostedTrees(whole["features"], **arrays)


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature, the distinct values at the ranks ``k n / bins``; nothing lies above the maximum."""
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.min, F.max)],
    ).first()
    n = stats["n"]
    if not n:
        raise ValueError("no rows to fit")
    ranges = {c: (n, stats[f"min_{c}"], stats[f"max_{c}"]) for c in features}
    at = [k * n // bins for k in range(1, bins)]
    found = values_at_ranks(rows, ranges, {c: at for c in features})
    return [sorted(v for v in set(found[c].values()) if v < ranges[c][2]) for c in features]


def _blocks(rows: DataFrame, features: Sequence[str], label: str, cuts: list[list[float]]) -> DataFrame:
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _full(parts):
            # feature by feature: what a task reads of one feature lies together
            bins = [np.searchsorted(c, piece[f].to_numpy(), "left").astype(np.uint8) for c, f in zip(cuts, features)]
            yield pd.DataFrame(
                {
                    "n": [len(piece)],
                    "bins": [np.stack(bins).tobytes()],
                    "labels": [piece[label].to_numpy(np.uint8).tobytes()],
                    "margins": [np.zeros(len(piece)).tobytes()],
                }
            )

    return rows.mapInPandas(pack, BLOCKS)


def _full(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task, ``BLOCK`` at a time."""
    held: list[pd.DataFrame] = []
    n = 0
    for part in parts:
        lo = 0
        while lo < len(part):
            held.append(part.iloc[lo : lo + BLOCK - n])
            lo, n = lo + len(held[-1]), n + len(held[-1])
            if n == BLOCK:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def _at(bins: np.ndarray, feature: np.ndarray, cut_bin: np.ndarray, levels: int, wanted: np.ndarray) -> np.ndarray:
    """Per row ``wanted`` of its node after so many levels; rows stay at a node that is not split.

    Goes node by node with a mask of rows: a few operations on bytes, where a walk row by row would gather
    every row's feature, value and cut at every level.
    """
    out = np.zeros(bins.shape[1], wanted.dtype)
    inside = [(0, np.ones(bins.shape[1], bool))]
    for level in range(levels + 1):
        below = []
        for node, rows in inside:
            if level < levels and feature[node] >= 0:
                right = bins[feature[node]] > cut_bin[node]
                below += [(2 * node + 1, rows & ~right), (2 * node + 2, rows & right)]
            elif wanted[node]:
                out += np.multiply(rows, wanted[node], dtype=wanted.dtype)
        inside = below
    return out


Block = tuple[int, bytes, bytes, bytes]
#: Cells (whole numbers that spell node, feature and bin) and their (gradient, Hessian).
Sums = tuple[np.ndarray, np.ndarray]


def _opened(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, bins, labels, margins = block
    return np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(labels, np.uint8), np.frombuffer(margins, float)


def _with_tree(block: Block, tree: tuple, depth: int) -> Block:
    """The block with the margins of one tree more."""
    bins, _, margin = _opened(block)
    feature, cut_bin, weight = tree
    numbers = np.arange(len(feature), dtype=np.min_scalar_type(len(feature)))
    return (*block[:3], (margin + weight[_at(bins, feature, cut_bin, depth, numbers)]).tobytes())


def _level_sums(blocks: Iterator[Block], tree: tuple, level: int, nodes: Sequence[int], bins: int) -> Iterator[Sums]:
    """Of the rows of the given nodes of a level, by feature, place of the node in ``nodes`` and bin."""
    feature, cut_bin = tree
    wanted = np.zeros(len(feature), np.min_scalar_type(len(nodes)))
    wanted[list(nodes)] = np.arange(1, len(nodes) + 1)
    total = None
    for block in blocks:
        binned, labels, margin = _opened(block)
        chosen = _at(binned, feature, cut_bin, level, wanted)
        here = np.flatnonzero(chosen)
        p = 1.0 / (1.0 + np.exp(-margin[here]))
        g = np.rint((p - labels[here]) * SCALE)
        h = np.rint(p * (1.0 - p) * SCALE)
        start = (chosen[here].astype(np.intp) - 1) * bins
        if total is None:
            total = np.zeros((2, len(binned), len(nodes) * bins))
        for f in range(len(binned)):
            place = start + binned[f].take(here)
            # sums of a task's rows stay below 2^53, so adding them as doubles is exact
            for k, w in enumerate((g, h)):
                total[k, f] += np.bincount(place, w, len(nodes) * bins)
    if total is not None:
        whole = total.reshape(2, -1).astype(np.int64)
        cells = np.flatnonzero(whole.any(axis=0))
        yield cells, whole[:, cells]


def _merged(a: Sums, b: Sums) -> Sums:
    cells, place = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    sums = np.zeros((2, len(cells)), np.int64)
    np.add.at(sums, (slice(None), place), np.concatenate((a[1], b[1]), axis=1))
    return cells, sums


def _summed(blocks: RDD, tree: tuple, level: int, nodes: Sequence[int], features: int, bins: int) -> np.ndarray:
    """Whole numbers by (node, feature, gradient or Hessian, bin); at most nodes x features x bins
    cells reach the driver from a task."""
    parts = blocks.mapPartitions(lambda rows: _level_sums(rows, tree, level, nodes, bins))
    if blocks.getNumPartitions() > DIRECT:
        found = [parts.treeReduce(_merged, depth=3)]
    else:
        found = parts.collect()
    table = np.zeros((2, features * len(nodes) * bins), np.int64)
    for cells, sums in found:
        table[:, cells] += sums
    return table.reshape(2, features, len(nodes), bins).transpose(2, 1, 0, 3)


def fit_newton(
    train: DataFrame,
    features: Sequence[str],
    label: str = "reordered",
    rounds: int = 200,
    depth: int = 6,
    rate: float = 0.1,
    bins: int = 64,
    l2: float = 1.0,
    least_hessian: float = 1.0,
    least_gain: float = 0.0,
) -> BoostedTrees:
    """Fit over all rows of ``train``. Nulls and absent features count as 0; a label is 0 or 1. Of
    splits with equal gain the first feature's least cut is taken."""
    spark = train.sparkSession
    features = list(features)
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    rows = align(train, features, [label]).persist()
    try:
        cuts = quantile_cuts(rows, features, bins)
        tasks = spark.sparkContext.defaultParallelism
        # rows are dealt again (which sorts them) only where few tasks would read them
        dealt = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
        blocks = _kept(_blocks(dealt, features, label, cuts))
    finally:
        rows.unpersist()
    nodes = 2 ** (depth + 1) - 1
    done: list[dict[str, np.ndarray]] = []
    older: RDD | None = None
    for _ in range(rounds):
        feature = np.full(nodes, -1)
        cut_bin, weight, gain = np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes)
        # nodes whose rows are summed at a level, and the sums of their parents
        light, above = [0], {}
        for level in range(depth):
            summed = dict(zip(light, _summed(blocks, (feature, cut_bin), level, light, len(features), bins)))
            for node, own in list(summed.items()) if level else []:
                summed[_sibling(node)] = above[(node - 1) // 2] - own
            light, above = [], summed
            for node, found in sorted(summed.items()):
                if level == 0:
                    weight[0] = _weight(found[0].sum(axis=1), l2, rate)
                best = _best_split(found, l2, least_hessian, least_gain)
                if best is None:
                    continue
                f, b, gain[node], left, right = best
                feature[node], cut_bin[node], weight[node] = f, b, 0.0
                weight[2 * node + 1], weight[2 * node + 2] = _weight(left, l2, rate), _weight(right, l2, rate)
                light.append(2 * node + 1 + int(right[1] < left[1]))
            if older is not None:  # this round's margins are made by now
                older.unpersist()
                older = None
            if not light:
                break
        done.append({"feature": feature, "cut_bin": cut_bin, "weight": weight, "gain": gain})
        tree, older = (feature, cut_bin, weight), blocks
        blocks = blocks.map(lambda block, tree=tree: _with_tree(block, tree, depth))
        if len(done) % KEEP_ROUNDS == 0 and len(done) < rounds:
            blocks = _kept(spark.createDataFrame(blocks, BLOCKS))
        else:
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.unpersist()
    if older is not None:
        older.unpersist()
    stacked = {k: np.array([t[k] for t in done]).reshape(len(done), nodes) for k in done[0]} if done else {}
    if not done:
        empty = np.zeros((0, nodes))
        return BoostedTrees(features, empty.astype(np.int64), empty, empty, empty)
    cut = np.zeros(stacked["weight"].shape)
    for r, i in zip(*np.nonzero(stacked["feature"] >= 0)):
        cut[r, i] = cuts[stacked["feature"][r, i]][stacked["cut_bin"][r, i]]
    return BoostedTrees(features, stacked["feature"], cut, stacked["weight"], stacked["gain"])


def _kept(blocks: DataFrame) -> RDD:
    """Blocks written to the shared folder, read back and held where memory allows."""
    spark = blocks.sparkSession
    path = scratch_path(spark, f"boosting-{uuid.uuid4().hex}")
    blocks.write.parquet(path)
    back = spark.read.schema(BLOCKS).parquet(path).rdd
    return back.map(lambda r: (r[0], bytes(r[1]), bytes(r[2]), bytes(r[3]))).persist(StorageLevel.MEMORY_AND_DISK)


def _sibling(node: int) -> int:
    return node + 1 if node % 2 else node - 1


def _weight(sums, l2: float, rate: float) -> float:
    g, h = (float(x) / SCALE for x in sums)
    return -g / (h + l2) * rate


def _best_split(found: np.ndarray, l2: float, least_hessian: float, least_gain: float):
    """Feature, bin, gain and the (gradient, Hessian) sums of both sides of the best split, or None."""
    left = found.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    (gl, hl), (gr, hr) = (x.transpose(1, 0, 2) / SCALE for x in (left, right))
    g, h = (total / SCALE).transpose(1, 0, 2)
    gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - g * g / (h + l2)
    allowed = (hl >= least_hessian) & (hr >= least_hessian) & (gain > least_gain)
    if not allowed.any():
        return None
    f, b = np.unravel_index(np.argmax(np.where(allowed, gain, -np.inf)), gain.shape)
    return int(f), int(b), float(gain[f, b]), left[f, :, b], right[f, :, b]


def predict_newton(model: BoostedTrees, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Class and probability of a reorder for every row, as ``models.predict``."""
    keep = [c for c in df.columns if c in KEY_COLUMNS] if keep is None else list(keep)
    rows = align(df, model.features, keep)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = rows.select(*keep, F.lit(0).alias("prediction"), F.lit(0.0).alias("reorder_probability")).schema

    def score(parts):
        import pyarrow as pa

        trees = shared.value
        for table in parts:
            values = np.stack([table.column(len(keep) + k).to_numpy() for k in range(len(trees.features))], axis=1)
            p = 1.0 / (1.0 + np.exp(-trees.margins(values)))
            columns = [*table.columns[: len(keep)], pa.array((p > 0.5).astype(np.int32)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(score, out)
