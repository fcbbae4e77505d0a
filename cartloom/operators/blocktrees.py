"""Spark's boosted trees and forests, fitted on blocks of binned rows.

The estimators take the parameters of ``GBTClassifier`` and ``RandomForestClassifier`` and give their
models, which are saved, loaded and applied as before. Only the search for the trees differs. Features are
binned once, at the cuts that Spark finds, so a row is a byte a feature and one for its label. Tables whose
rows would take Spark at most ``KEPT_BYTES`` are still fitted by Spark.

**Boosting** is a long chain of short steps, so the loop runs on the RDD of the blocks, as in ``boosting``: a
level of a tree is one job of sums by node, feature and bin. Residuals are rounded to multiples of 2^-28 and
added as whole numbers, so the trees do not depend on how rows are dealt, given the cuts. They are those of
Spark but where two splits have the same gain: here the first feature's least cut is taken, there rounding
decides. Of two children the smaller is summed, the other is the rest. Every ``KEEP_ROUNDS`` rounds a checkpoint ends the lineage.

**A forest** has independent trees, so a job is a level of ``GROUP`` trees. Nothing is kept for a row: how
often a tree holds it is drawn again from the tree and the block, and its node is found by walking down. Sums
of nodes are added up, and split, in tasks by tree. Spark's own fit keeps a count and a node per row and
tree, about a kilobyte a row with a hundred trees.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.sources.stage import scratch_path

#: Rows of a block: small ones are dealt evenly, large ones need fewer draws.
DEALT_BLOCK = 1 << 12
FOREST_BLOCK = 1 << 16
#: Rows that are worked on at once: their bins stay in a core's cache.
CHUNK = 1 << 15
#: Rows of a task of boosting, at least (a task costs more than they do) and at most.
LEAST_ROWS = 20_000
MOST_ROWS = 1 << 23
KEEP_ROUNDS = 50
#: Tasks whose sums the driver adds itself; those of more are combined in tasks first.
DIRECT = 64
#: Residuals are whole multiples of 1 / SCALE; 2^33 rows fit a sum.
SCALE = 1 << 28
#: Gains below are rounding.
NO_GAIN = 1e-14
#: Trees that are grown at once.
GROUP = 25
#: What Spark's own fit may keep of the rows: ``ROW_BYTES`` each, and a forest ``TREE_BYTES`` a tree. Up to
#: about here a round of boosting takes it no longer than the jobs of a round on blocks.
KEPT_BYTES = 512 << 20
ROW_BYTES = 256
TREE_BYTES = 8

#: Rows, bins, labels, margins, residuals, and by node the squares of the residuals before.
Block = tuple[int, bytes, bytes, bytes, bytes, bytes]

BLOCKS = "id long, n int, bins binary, labels binary"
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: long, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Tree:
    """A tree as arrays over node numbers: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``.

    A row goes on from a node to ``base`` plus whether its bin of ``feature`` is above ``cut``. A leaf has
    itself as ``base`` and a ``cut`` that no bin is above. ``stats`` are what the impurity is made of.
    """

    feature: np.ndarray
    cut: np.ndarray
    base: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @staticmethod
    def leaf(depth: int, stats: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.zeros(n, np.intp), np.full(n, 255, np.uint8), np.arange(n, dtype=np.min_scalar_type(n)), np.full(n, -1.0), np.zeros((n, stats)))

    def split(self, node: int, feature: int, cut: int, gain: float) -> None:
        self.feature[node], self.cut[node], self.base[node], self.gain[node] = feature, cut, 2 * node + 1, gain

    def step(self, bins: np.ndarray, width: int, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The next nodes of ``rows`` of flat ``bins``, a feature being ``width`` bytes."""
        here = bins[self.feature[node] * width + rows]
        return self.base[node] + (here > self.cut[node])


# --- rows --------------------------------------------------------------------------


def spark_cuts(dataset: DataFrame, features: str, n_rows: int, bins: int, seed: int) -> list[list[float]]:
    """Where Spark's trees cut each feature: at quantiles of a sample of about ``bins^2`` or 10,000 rows."""
    jvm = dataset.sparkSession.sparkContext._jvm
    rows = dataset.select(vector_to_array(features).alias("x"))
    share = min(1.0, max(bins * bins, 10_000) / n_rows)
    if share < 1:
        # the sampler and the seed of Spark's fit
        number = jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sampled = rows._jdf.toJavaRDD().sample(False, share, number)
        session = dataset.sparkSession
        rows = DataFrame(session._jsparkSession.createDataFrame(sampled, rows._jdf.schema()), session)
    sample = np.array([r[0] for r in rows.collect()], float)
    bins = min(bins, n_rows)
    return [_feature_cuts(sample[:, f], share * n_rows, bins - 1) for f in range(sample.shape[1])]


def _feature_cuts(values: np.ndarray, expected: float, most: int) -> list[float]:
    """At most ``most`` cuts, midway between neighbours; zeros are counted as the rest of ``expected`` rows."""
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    known = int(counts.sum())
    weights = dict(zip(distinct.tolist(), counts.astype(float).tolist()))
    if expected - known > 2.0**-52 * known * known:
        weights[0.0] = expected - known
    at = sorted(weights)
    middles = [(a + b) / 2 for a, b in zip(at, at[1:])]
    if len(middles) <= most:
        return middles
    stride = expected / (most + 1)
    found, total, target = [], weights[at[0]], stride
    for middle, value in zip(middles, at[1:]):
        before, total = total, total + weights[value]
        if abs(before - target) < abs(total - target):
            found.append(middle)
            target += stride
    return found


def binned(dataset: DataFrame, label: str, features: str, cuts: list[list[float]], size: int) -> DataFrame:
    """Blocks of at most ``size`` rows: their bins feature by feature, and their labels."""

    def pack(batches):
        import pyarrow as pa

        part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(piece: np.ndarray):
            places = [np.searchsorted(c, piece[:, f], "left").astype(np.uint8) for f, c in enumerate(cuts)]
            labels = piece[:, -1].astype(np.uint8)
            columns = [[(part << 32) + made], [len(piece)], [np.stack(places).tobytes()], [labels.tobytes()]]
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n", "bins", "labels"])

        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(cuts))
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            if not ((y == 0) | (y == 1)).all():
                raise ValueError("a label must be 0 or 1")
            held.append(np.column_stack((x, y)))
            count += len(y)
            if count >= size:
                whole, at = np.concatenate(held), 0
                while count - at >= size:
                    yield block(whole[at : at + size])
                    made, at = made + 1, at + size
                held, count = [whole[at:]], count - at
        if count:
            yield block(np.concatenate(held))

    rows = dataset.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    return rows.mapInArrow(pack, BLOCKS)


# --- boosting ----------------------------------------------------------------------


def _opened(blocks: Iterator[tuple], nodes: int) -> Iterator[Block]:
    """Larger blocks, with the residuals of the first round: the labels themselves, as -1 and 1."""
    held, n = [], 0

    def block() -> Block:
        bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, k) for k, b, _ in held], axis=1)
        labels = b"".join(y for *_, y in held)
        sign = np.frombuffer(labels, np.uint8) * 2.0 - 1.0
        return n, bins.tobytes(), labels, bytes(8 * n), (sign * SCALE).astype(np.int32).tobytes(), bytes(8 * nodes)

    for one in blocks:
        held.append(one)
        n += one[0]
        if n >= CHUNK:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def _with_tree(block: Block, tree: Tree, depth: int, values: np.ndarray) -> Block:
    """The block after one tree more: margins, residuals, and the squares of the old ones by leaf."""
    n, bins, labels, margins, residuals, _ = block
    node = _walked(np.frombuffer(bins, np.uint8), n, tree, depth)
    squares = np.bincount(node, (np.frombuffer(residuals, np.int32) / SCALE) ** 2, len(tree.base))
    margin = np.frombuffer(margins) + values[node]
    sign = np.frombuffer(labels, np.uint8) * 2.0 - 1.0
    with np.errstate(over="ignore"):
        residual = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
    return n, bins, labels, margin.tobytes(), np.rint(residual * SCALE).astype(np.int32).tobytes(), squares.tobytes()


def _walked(bins: np.ndarray, n: int, tree: Tree, levels: int) -> np.ndarray:
    """The node of each row after so many levels."""
    rows, node = np.arange(n), np.zeros(n, tree.base.dtype)
    for _ in range(levels):
        node = tree.step(bins, n, rows, node)
    return node


def _node_sums(blocks: Iterator[Block], tree: Tree, level: int, nodes: Sequence[int], width: int) -> Iterator[list[np.ndarray]]:
    """Rows and residuals by (feature, place of a node in ``nodes``, bin), and the blocks' squares."""
    place = np.full(len(tree.base), -1, np.intp)
    place[list(nodes)] = np.arange(len(nodes)) * width
    cells, found = len(nodes) * width, None
    for n, packed, _, _, residuals, squared in blocks:
        flat, q = np.frombuffer(packed, np.uint8), np.frombuffer(residuals, np.int32)
        bins = flat.reshape(-1, n)
        if found is None:
            found = [np.zeros((len(bins), cells), np.int64), np.zeros((len(bins), cells), np.int64), np.zeros(len(tree.base))]
        counts, sums, squares = found
        squares += np.frombuffer(squared)
        start = place[_walked(flat, n, tree, level)]
        here = np.flatnonzero(start >= 0) if level else slice(None)
        start, weight = start[here], q[here].astype(float)
        for f in range(len(bins)):
            cell = start + bins[f][here]
            counts[f] += np.bincount(cell, minlength=cells)
            # whole numbers below 2^53, so adding them as doubles is exact
            sums[f] += np.bincount(cell, weight, cells).astype(np.int64)
    if found is not None:
        yield found


def _added(blocks: RDD, tree: Tree, level: int, nodes: Sequence[int], width: int) -> list[np.ndarray]:
    """``_node_sums`` over all tasks: (node, feature, bin) twice, and the squares by node."""
    parts = blocks.mapPartitions(lambda part: _node_sums(part, tree, level, nodes, width))
    if blocks.getNumPartitions() > DIRECT:
        counts, sums, squares = parts.treeReduce(lambda a, b: [x + y for x, y in zip(a, b)], depth=3)
    else:
        counts, sums, squares = (sum(p[1:], p[0]) for p in zip(*parts.collect()))
    shape = (len(counts), len(nodes), width)
    return [counts.reshape(shape).transpose(1, 0, 2), sums.reshape(shape).transpose(1, 0, 2), squares]


def _variance_split(counts: np.ndarray, sums: np.ndarray, allowed: np.ndarray, least: int, least_gain: float):
    """Feature, bin and gain of the best split and (rows, residuals) of its left side, or None."""
    left_n, left_s = counts.cumsum(axis=1), sums.cumsum(axis=1)
    n, s = int(left_n[0, -1]), int(left_s[0, -1])
    right_n = n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = left_s / SCALE, (s - left_s) / SCALE
        gain = (a * a / left_n + b * b / right_n - (s / SCALE) ** 2 / n) / n
    good = allowed & (left_n >= least) & (right_n >= least) & (gain >= least_gain) & (gain > NO_GAIN)
    if not good.any():
        return None
    f, k = np.unravel_index(np.argmax(np.where(good, gain, -np.inf)), gain.shape)
    return int(f), int(k), float(gain[f, k]), int(left_n[f, k]), int(left_s[f, k])


class BlockGBTClassifier(GBTClassifier):
    """``GBTClassifier`` fitted on blocks once its rows would take more than ``KEPT_BYTES``."""

    def by_blocks(self, n_rows: int) -> bool:
        return _plain(self) and self.getFeatureSubsetStrategy() == "all" and n_rows * ROW_BYTES > KEPT_BYTES

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        spark, n_rows = dataset.sparkSession, dataset.count()
        if not self.by_blocks(n_rows):
            return super()._fit(dataset)
        cuts = spark_cuts(dataset, self.getFeaturesCol(), n_rows, self.getMaxBins(), self.getSeed())
        depth, rate, rounds = self.getMaxDepth(), self.getStepSize(), self.getMaxIter()
        tasks = max(min(spark.sparkContext.defaultParallelism, -(-n_rows // LEAST_ROWS)), -(-n_rows // MOST_ROWS))
        dealt = binned(dataset, self.getLabelCol(), self.getFeaturesCol(), cuts, DEALT_BLOCK).repartition(tasks)
        plain = dealt.rdd.map(lambda r: (r[1], bytes(r[2]), bytes(r[3])))
        nodes = 2 ** (depth + 1) - 1
        blocks = plain.mapPartitions(lambda part: _opened(part, nodes)).persist(StorageLevel.MEMORY_AND_DISK)
        allowed = _allowed(cuts)
        trees: list[Tree] = []
        older, kept = None, None
        for r in range(rounds):
            tree, squares = self._tree(blocks, depth, allowed)
            if trees:
                _square(trees[-1], squares)
            trees.append(tree)
            if older is not None:  # this round's residuals are made by now
                older.unpersist()
            with np.errstate(divide="ignore", invalid="ignore"):
                values = np.nan_to_num(tree.stats[:, 1] / tree.stats[:, 0]) * (rate if r else 1.0)
            older, blocks = blocks, blocks.map(lambda b, tree=tree, values=values: _with_tree(b, tree, depth, values))
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % KEEP_ROUNDS == 0 and r + 1 < rounds:
                blocks.checkpoint()  # the lineage ends at files of the shared folder
                blocks.count()
                if kept is not None:
                    _delete(spark, kept)
                kept = blocks.getCheckpointFile()
        _square(trees[-1], _added(blocks, trees[-1], 0, [0], allowed.shape[1])[2])
        for done in (older, blocks):
            done.unpersist()
        if kept is not None:
            _delete(spark, kept)
        path = _write_model(self, spark, trees, cuts, [1.0] + [rate] * (rounds - 1), _variance_node, "regression.DecisionTreeRegressionModel", {})
        return GBTClassificationModel.load(path)

    def _tree(self, blocks: RDD, depth: int, allowed: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The next tree, a job a level, and the squares that the blocks hold of the last one."""
        least, least_gain, width = self.getMinInstancesPerNode(), self.getMinInfoGain(), allowed.shape[1]
        tree, light, above, held = Tree.leaf(depth, 3), [0], {}, None
        for level in range(depth):
            counts, sums, squares = _added(blocks, tree, level, light, width)
            held = squares if held is None else held
            found = dict(zip(light, zip(counts, sums)))
            for own, (c, s) in list(found.items()) if level else []:
                whole = above[(own - 1) // 2]
                found[own + 1 if own % 2 else own - 1] = (whole[0] - c, whole[1] - s)
            light, above = [], found
            for own, (c, s) in sorted(found.items()):
                n, total = int(c[0].sum()), int(s[0].sum())
                tree.stats[own, :2] = n, total / SCALE
                best = _variance_split(c, s, allowed, least, least_gain)
                if best is None:
                    continue
                f, k, gain, n_left, s_left = best
                tree.split(own, f, k, gain)
                tree.stats[2 * own + 1, :2] = n_left, s_left / SCALE
                tree.stats[2 * own + 2, :2] = n - n_left, (total - s_left) / SCALE
                light.append(2 * own + 1 + int(n - n_left < n_left))
            if not light:
                break
        return tree, held


def _square(tree: Tree, squares: np.ndarray) -> None:
    """Completes ``stats``: a node's squares are those of its children."""
    squares = squares.copy()
    for i in range(len(squares) - 1, 0, -1):
        squares[(i - 1) // 2] += squares[i]
    tree.stats[:, 2] = squares


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


# --- forest ------------------------------------------------------------------------


def _poisson() -> np.ndarray:
    """How often a row is held, by a number of 16 bits: Poisson with mean 1."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(shares, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _forest_sums(blocks, state: list, seed: int, level: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per tree, rows by (node, place of the feature in its subset, bin, label)."""
    times = _poisson()
    totals = {}
    for ident, n, packed, labels in blocks:
        flat, y = np.frombuffer(packed, np.uint8), np.frombuffer(labels, np.uint8)
        for number, tree, nodes, subsets in state:
            draws = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, number, ident])).integers(0, 1 << 16, n, np.uint16)
            held = times[draws]
            every = np.flatnonzero(held)
            place = np.full(len(tree.base), -1, np.intp)
            place[nodes] = np.arange(len(nodes))
            picks = subsets.shape[1]
            cells = len(nodes) * picks * width * 2
            if number not in totals:
                totals[number] = np.zeros(cells, np.int64)
            for lo in range(0, len(every), CHUNK):
                rows = every[lo : lo + CHUNK]
                node = np.zeros(len(rows), tree.base.dtype)
                for _ in range(level):
                    node = tree.step(flat, n, rows, node)
                at = place[node]
                inside = np.flatnonzero(at >= 0)
                if len(inside) < len(rows):
                    rows, at = rows[inside], at[inside]
                weight = held[rows].astype(float)
                shared = at * (picks * width * 2) + y[rows]
                for j in range(picks):
                    cell = shared + flat[subsets[:, j][at] * n + rows].astype(np.intp) * 2 + j * width * 2
                    totals[number] += np.bincount(cell, weight, cells).astype(np.int64)
    for number, total in totals.items():
        yield number, total.astype(np.min_scalar_type(int(total.max(initial=0))))


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - ((counts / n[..., None]) ** 2).sum(axis=-1)


def _gini_splits(sums: np.ndarray, subsets: np.ndarray, allowed: np.ndarray, least: int, least_gain: float) -> tuple[np.ndarray, ...]:
    """Per node: the rows by label, whether it is split, feature, bin, gain and rows of its left side."""
    nodes, picks = subsets.shape
    counts = sums.astype(np.int64).reshape(nodes, picks, -1, 2)
    left = counts.cumsum(axis=2)
    total = left[:, 0, -1]
    right = total[:, None, None] - left
    n_left, n_right, n = left.sum(axis=3), right.sum(axis=3), total.sum(axis=1)[:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(total)[:, None, None] - n_left / n * _gini(left) - n_right / n * _gini(right)
    good = allowed[subsets] & (n_left >= least) & (n_right >= least) & (gain >= least_gain) & (gain > NO_GAIN)
    best = np.where(good, gain, -np.inf).reshape(nodes, -1).argmax(axis=1)
    j, k = np.unravel_index(best, gain.shape[1:])
    own = np.arange(nodes)
    return total, good[own, j, k], subsets[own, j], k, gain[own, j, k], left[own, j, k]


class BlockForestClassifier(RandomForestClassifier):
    """``RandomForestClassifier`` fitted on blocks once its rows would take more than ``KEPT_BYTES``."""

    def by_blocks(self, n_rows: int) -> bool:
        usual = self.getFeatureSubsetStrategy() == "auto" and self.getBootstrap() and self.getImpurity() == "gini"
        return usual and _plain(self) and n_rows * (ROW_BYTES + TREE_BYTES * self.getNumTrees()) > KEPT_BYTES

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark, n_rows = dataset.sparkSession, dataset.count()
        if not self.by_blocks(n_rows):
            return super()._fit(dataset)
        cuts = spark_cuts(dataset, self.getFeaturesCol(), n_rows, self.getMaxBins(), self.getSeed())
        path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
        try:
            binned(dataset, self.getLabelCol(), self.getFeaturesCol(), cuts, FOREST_BLOCK).write.parquet(path)
            trees = []
            for first in range(0, self.getNumTrees(), GROUP):
                trees += self._group(spark, path, range(first, min(first + GROUP, self.getNumTrees())), cuts)
        finally:
            _delete(spark, path)
        saved = _write_model(self, spark, trees, cuts, [1.0] * len(trees), _gini_node, "classification.DecisionTreeClassificationModel", {"numClasses": 2})
        return RandomForestClassificationModel.load(saved)

    def _group(self, spark: SparkSession, path: str, numbers: Sequence[int], cuts: list[list[float]]) -> list[Tree]:
        """The trees of these numbers, a job a level."""
        sc, depth, seed = spark.sparkContext, self.getMaxDepth(), self.getSeed()
        least, least_gain = self.getMinInstancesPerNode(), self.getMinInfoGain()
        allowed = _allowed(cuts)
        width, picks = allowed.shape[1], math.ceil(math.sqrt(len(cuts))) if self.getNumTrees() > 1 else len(cuts)
        blocks = spark.read.schema(BLOCKS).parquet(path).rdd
        # a task holds its sums once, however many blocks it reads
        tasks = min(blocks.getNumPartitions(), max(sc.defaultParallelism, 1))
        blocks = blocks.coalesce(tasks).map(lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3])))
        trees = {t: Tree.leaf(depth, 2) for t in numbers}
        open_nodes = {t: np.array([0]) for t in numbers}
        for level in range(depth):
            state = []
            for t, nodes in open_nodes.items():
                draw = np.random.default_rng([seed & 0xFFFFFFFF, t, level]).random((len(nodes), len(cuts)))
                state.append((t, trees[t], nodes, np.sort(draw.argsort(axis=1)[:, :picks], axis=1)))
            if not state:
                break
            subsets = {t: s for t, _, _, s in state}
            shared = sc.broadcast((state, subsets))
            sums = blocks.mapPartitions(lambda part: _forest_sums(part, shared.value[0], seed, level, width))
            splits = sums.reduceByKey(lambda a, b: a.astype(np.int64) + b, min(len(state), tasks)).map(
                lambda s: (s[0], _gini_splits(s[1], shared.value[1][s[0]], allowed, least, least_gain))
            )
            found = splits.collect()
            shared.destroy()
            below = {}
            for t, (total, good, feature, k, gain, left) in found:
                tree, nodes = trees[t], open_nodes[t]
                tree.stats[nodes] = total
                for i in np.flatnonzero(good):
                    node = int(nodes[i])
                    tree.split(node, int(feature[i]), int(k[i]), float(gain[i]))
                    tree.stats[2 * node + 1], tree.stats[2 * node + 2] = left[i], total[i] - left[i]
                children = np.concatenate([2 * nodes[good] + 1, 2 * nodes[good] + 2])
                children = np.sort(children[(tree.stats[children] > 0).all(axis=1)])
                if len(children):
                    below[t] = children
            open_nodes = {t: below[t] for t in numbers if t in below}
        return [trees[t] for t in numbers]


# --- models ------------------------------------------------------------------------


def _plain(estimator) -> bool:
    """Whether every row counts once and is used in the fit: what blocks are made for."""
    extra = ("weightCol", "validationIndicatorCol")
    unset = not any(estimator.hasParam(p) and estimator.isSet(estimator.getParam(p)) for p in extra)
    whole = estimator.getSubsamplingRate() == 1.0 and estimator.getMinWeightFractionPerNode() == 0.0
    return unset and whole and estimator.getMaxBins() <= 256 and estimator.getMaxDepth() > 0


def _allowed(cuts: list[list[float]]) -> np.ndarray:
    """Whether a feature has a cut after a bin; one more bin than the most cuts."""
    width = max(map(len, cuts)) + 1
    return np.arange(width) < np.array([len(c) for c in cuts])[:, None]


def _variance_node(stats: np.ndarray) -> tuple[float, float]:
    n, total, squares = stats
    mean = total / n
    return float(mean), float(max(squares / n - mean * mean, 0.0))


def _gini_node(stats: np.ndarray) -> tuple[float, float]:
    return float(stats.argmax()), float(_gini(stats))


def _write_model(estimator, spark: SparkSession, trees: Sequence[Tree], cuts, weights: Sequence[float], value, tree_class: str, extra: dict) -> str:
    """The files of a saved model of Spark's, which only its reader can make from Python."""
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    now, version = int(time.time() * 1000), spark.version
    values = {p.name: v for p, v in estimator._paramMap.items()}
    defaults = {p.name: v for p, v in estimator._defaultParamMap.items()}
    model_class = "org.apache.spark.ml.classification." + (
        "GBTClassificationModel" if isinstance(estimator, GBTClassifier) else "RandomForestClassificationModel"
    )
    head = {"class": model_class, "timestamp": now, "sparkVersion": version, "uid": estimator.uid}
    head |= {"paramMap": values, "defaultParamMap": defaults, "numFeatures": len(cuts), **extra, "numTrees": len(trees)}
    of_tree = {k: values[k] for k in ("cacheNodeIds", "checkpointInterval", "labelCol", "maxDepth", "seed") if k in values}
    rows, heads = [], []
    for number, tree in enumerate(trees):
        one = {"class": f"org.apache.spark.ml.{tree_class}", "timestamp": now, "sparkVersion": version}
        heads.append((number, json.dumps(one | {"uid": f"tree_{uuid.uuid4().hex[:12]}", "paramMap": of_tree, "defaultParamMap": {"impurity": defaults["impurity"]}}), weights[number]))
        reached = [0]
        for i in reached:
            reached += [2 * i + 1, 2 * i + 2] if tree.base[i] != i else []
        found = {i: value(tree.stats[i]) for i in reached}
        leaves = {i for i in reached if tree.base[i] == i}
        for i in reversed(reached):  # like Spark, leaves that say the same are their parent
            below = {2 * i + 1, 2 * i + 2}
            if i not in leaves and below <= leaves and found[2 * i + 1][0] == found[2 * i + 2][0]:
                leaves = leaves - below | {i}
        reached = [0]
        for i in reached:
            reached += [2 * i + 1, 2 * i + 2] if i not in leaves else []
        place = {i: k for k, i in enumerate(reached)}
        for i in reached:
            prediction, impurity = found[i]
            stats = [float(s) for s in tree.stats[i]]
            raw = int(stats[0]) if tree.stats.shape[1] == 3 else int(sum(stats))
            if i not in leaves:
                f = int(tree.feature[i])
                split = (f, [float(cuts[f][tree.cut[i]])], -1)
                after = (float(tree.gain[i]), place[2 * i + 1], place[2 * i + 2], split)
            else:
                after = (-1.0, -1, -1, (-1, [], -1))
            rows.append((number, (place[i], prediction, impurity, stats, raw, *after)))
    spark.createDataFrame(rows, NODES).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return path
