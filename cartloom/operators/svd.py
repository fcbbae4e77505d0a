"""Truncated singular value decomposition of a sparse matrix of any width.

Rows are (key, term numbers, weights). A random block of vectors over the terms, a little wider than the
number of components, is multiplied by the matrix and its transpose in turn and made orthonormal in
between (randomised range finder with subspace iteration), until the wanted singular values stand still.

Nothing of the size of terms x terms is formed. The orthonormal factor of ``Y = A X`` is never formed either:
a tall-skinny QR gives its small triangle ``R`` (each task reduces its rows to one triangle,
triangles are reduced in turn), and ``A' Q = (A' Y) R^-1``.

While the block over the terms fits ``FACTOR_BYTES`` it goes to every task, and one iteration is one
pass over the rows: each task adds up its part of ``A' Y`` next to its triangle. Beyond that both
products are joins, with the terms on their own keys, and the block stays a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.sources.stage import scratch_path

FACTOR_BYTES = 64 << 20
#: Bytes of partial products that the driver adds itself; more are added in tasks first.
DIRECT_BYTES = 128 << 20
#: Entries that a task multiplies at a time.
ENTRIES = 1 << 14


@dataclass(frozen=True)
class Svd:
    """``values``: the largest singular values, descending. ``scores``: a row per key with ``scores``, the
    row times the right singular vectors. ``loadings``: a row per term number ``i`` with ``loadings``.
    The largest loading of each vector is positive."""

    values: np.ndarray
    scores: DataFrame
    loadings: DataFrame
    rounds: int


def start_block(numbers: np.ndarray, width: int) -> np.ndarray:
    """Rows of the starting block, from hashes of term number and column, so any task can make them."""
    x = numbers.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(1, width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ ((x + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift))
            x = x * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2**52 - 1


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    """The R of a QR of stacked rows, made square; a zero on the diagonal marks a lost direction."""
    r = np.linalg.qr(np.vstack(parts), mode="r")
    width = r.shape[1]
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def inverse(r: np.ndarray) -> np.ndarray:
    """A pseudo-inverse that drops directions without weight."""
    return np.linalg.pinv(r, rcond=1e-12)


def truncated_svd(
    rows: DataFrame,
    key: str,
    k: int,
    n_terms: int,
    extra: int = 100,
    tolerance: float = 1e-11,
    most_rounds: int = 100,
    factor_bytes: int = FACTOR_BYTES,
) -> Svd:
    """The ``k`` largest singular values and vectors of ``rows``: ``key``, ``i`` (array of term numbers, 0 to
    ``n_terms`` - 1, no repeats) and ``w`` (array of weights). Pass a written table; it is read once
    a round. ``extra`` is how much wider than ``k`` the block is. An empty table has zero values."""
    if not 0 < k <= n_terms:
        raise ValueError(f"{k} components from {n_terms} terms")
    width = min(n_terms, k + extra)
    small = n_terms * width * 8 <= factor_bytes
    work = _Passes(rows, key, n_terms, width) if small else _Joins(rows, key, n_terms, width)
    before = np.full(k, np.inf)
    values = np.zeros(k)
    for done in range(1, most_rounds + 1):
        r = work.iterate()
        values = np.linalg.svd(r, compute_uv=False)[:k]
        if done > 1 and np.all(np.abs(values - before) <= tolerance * max(values[0], 1e-300)):
            break
        before = values
    return work.finish(k, done)


def checks(rows: DataFrame, key: str, found: Svd, digits: float = 1e-6) -> DataFrame:
    """What holds of a decomposition of ``rows``, in one row: ``n_rows``, ``squared_norm`` of the matrix,
    and whether the loadings are orthonormal, the scores are orthogonal with the values as their
    lengths, the matrix times its transpose scales each vector by its squared value, and what the
    vectors leave of the matrix is the squared norm less the squared values."""
    k, values = len(found.values), [float(v) for v in found.values]
    scale = max(values[0], 1e-300) ** 2

    def products(table: DataFrame, column: str, wanted, near: float, name: str) -> DataFrame:
        """Whether the sums of products of two vectors' entries are as wanted, for all pairs of vectors."""
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        sums = [F.coalesce(F.sum(F.col(column)[a] * F.col(column)[b]), F.lit(0.0)) for a, b in pairs]
        close = [F.abs(s - F.lit(float(wanted(a, b)))) <= near for s, (a, b) in zip(sums, pairs)]
        return table.agg(F.forall(F.array(*close), lambda x: x).alias(name))

    orthonormal = products(found.loadings, "loadings", lambda a, b: a == b, digits, "orthonormal")
    lengths = products(found.scores, "scores", lambda a, b: values[a] ** 2 * (a == b), digits * scale, "lengths_are_values")
    zipped = F.inline(F.arrays_zip(F.col("i"), F.col("w")))
    # rows move to their scores, not their entries one by one
    entries = rows.select(key, "i", "w").join(found.scores, key).select(key, "scores", zipped)
    again = entries.groupBy("i").agg(*[F.sum(F.col("w") * F.col("scores")[c]).alias(f"z{c}") for c in range(k)])
    apart = F.greatest(
        F.lit(0.0), *[F.max(F.abs(F.col(f"z{c}") - F.col("loadings")[c] * values[c] ** 2)) for c in range(k)]
    )
    scaled = again.join(found.loadings, "i").agg((apart <= digits * scale).alias("vectors_are_scaled"))
    left = entries.join(found.loadings, "i").groupBy(key).agg(
        # a row less its part along the vectors: its norm less that of the part, as the part is recomputed
        F.sum(F.col("w") * F.col("w")).alias("norm"),
        *[F.sum(F.col("w") * F.col("loadings")[c]).alias(f"p{c}") for c in range(k)],
    )
    part = sum((F.col(f"p{c}") * F.col(f"p{c}") for c in range(1, k)), F.col("p0") * F.col("p0"))
    kept = sum(v * v for v in values)
    norm, rest = F.coalesce(F.sum("norm"), F.lit(0.0)), F.coalesce(F.sum(F.col("norm") - part), F.lit(0.0))
    residual = left.agg(norm.alias("squared_norm"), (F.abs(norm - kept - rest) <= digits * scale * k).alias("residual_adds_up"))
    # five tables of a row each, side by side: each column is null in all but one
    parts = [rows.agg(F.count(F.lit(1)).alias("n_rows")), residual, orthonormal, lengths, scaled]
    below = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return below.agg(*[F.max(c).alias(c) for c in below.columns])


class _Passes:
    """The block over the terms is an array; an iteration is one pass over the rows."""

    def __init__(self, rows: DataFrame, key: str, n_terms: int, width: int):
        self.rows, self.key, self.n_terms, self.width = rows, key, n_terms, width
        self.block = np.linalg.qr(start_block(np.arange(n_terms), width))[0]
        self.tasks = rows.rdd.getNumPartitions()

    def iterate(self) -> np.ndarray:
        """One iteration; the triangle of ``A X`` for the orthonormal ``X`` before it."""
        spark, width, n_terms = self.rows.sparkSession, self.width, self.n_terms
        shared = spark.sparkContext.broadcast(self.block)

        def multiply(parts):
            import pyarrow as pa

            x, r = shared.value, np.zeros((0, width))
            z = np.zeros((n_terms, width))
            for table in parts:
                for _, i, w, starts in _pieces(table, 0):
                    # the terms of a piece are few; over them it is dense enough for matrix products
                    terms, piece = _dense(i, w, starts)
                    y = piece @ x[terms]
                    r = triangle([r, y])
                    z[terms] += piece.T @ y
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary())], names=["r", "z"]
            )

        found = self.rows.select("i", "w").mapInArrow(multiply, "r binary, z binary")
        triangles, total = [], np.zeros((n_terms, width))
        if self.tasks * n_terms * width * 8 <= DIRECT_BYTES:
            for row in found.collect():
                triangles.append(np.frombuffer(row["r"]).reshape(-1, width))
                total += np.frombuffer(row["z"]).reshape(n_terms, width)
        else:
            add = lambda a, b: (triangle([a[0], b[0]]), a[1] + b[1])
            opened = found.rdd.map(lambda row: (np.frombuffer(row[0]).reshape(-1, width), np.frombuffer(row[1]).reshape(n_terms, width)))
            r, total = opened.treeReduce(add, depth=3)
            triangles = [r]
        shared.unpersist()
        r = triangle([np.zeros((0, width)), *triangles])
        self.last, self.r = self.block, r
        self.block = np.linalg.qr(total @ inverse(r))[0]
        return r

    def finish(self, k: int, rounds: int) -> Svd:
        _, values, vt = np.linalg.svd(self.r)
        vectors = self.last @ vt[:k].T
        biggest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[biggest, np.arange(k)] < 0, -1.0, 1.0)
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast(vectors)
        source = self.rows.select(self.key, "i", "w")
        out = source.select(self.key, F.array(F.lit(0.0)).alias("scores")).schema

        def project(parts):
            import pyarrow as pa

            for table in parts:
                for lo, i, w, starts in _pieces(table, 1):
                    terms, piece = _dense(i, w, starts)
                    y = piece @ shared.value[terms]
                    lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([table.column(0).slice(lo, len(y)), lists], names=out.names)

        # the block over the terms fits the driver, that is how this form was chosen
        loadings = spark.createDataFrame(
            [(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "i int, loadings array<double>"
        )
        return Svd(values[:k], source.mapInArrow(project, out), loadings, rounds)


def _pieces(table, first: int):
    """(first row, term numbers, weights, row starts) of runs of rows of about ``ENTRIES`` entries."""
    i, w = table.column(first), table.column(first + 1)
    starts = i.offsets.to_numpy()
    terms, weights = i.values.to_numpy(), w.values.to_numpy()
    shift = w.offsets.to_numpy()[0] - starts[0]
    lo = 0
    while lo < table.num_rows:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + ENTRIES, "right")) - 1)
        hi = min(hi, table.num_rows)
        a, b = starts[lo], starts[hi]
        yield lo, terms[a:b], weights[a + shift : b + shift], starts[lo : hi + 1] - a
        lo = hi


def _dense(i: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some rows, and the rows over these terms."""
    terms, column = np.unique(i, return_inverse=True)
    out = np.zeros((len(starts) - 1, len(terms)))
    out[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), column] = w
    return terms, out


class _Joins:
    """The block over the terms is a table (i, x0, x1, ...); both products are joins."""

    def __init__(self, rows: DataFrame, key: str, n_terms: int, width: int):
        self.key, self.width = key, width
        self.columns = [f"x{j}" for j in range(width)]
        self.rows = rows
        self.entries = self._written(
            rows.select(key, F.inline(F.arrays_zip(F.col("i"), F.col("w")))), "entries"
        )
        terms = self.entries.select("i").distinct()
        block = self._mapped(terms, "i", [], lambda n, _: start_block(n, width))
        self.block = self._orthonormal(self._written(block, "block"))

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, f"svd-{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _mapped(self, df: DataFrame, by: str, columns: list[str], make) -> DataFrame:
        """``by`` and the columns of ``make(by, values)``."""
        width = self.width
        names = self.columns
        out = df.select(by, *[F.lit(0.0).alias(c) for c in names]).schema

        def run(parts):
            import pyarrow as pa

            for table in parts:
                own = table.column(0).to_numpy(zero_copy_only=False) if by == "i" else None
                values = np.stack([table.column(1 + j).to_numpy() for j in range(len(columns))], axis=1) if columns else None
                made = make(own, values)
                yield pa.RecordBatch.from_arrays([table.column(0), *[pa.array(made[:, j].copy()) for j in range(width)]], names=out.names)

        return df.select(by, *columns).mapInArrow(run, out)

    def _triangle(self, table: DataFrame) -> np.ndarray:
        width = self.width

        def reduce(parts):
            import pyarrow as pa

            r = np.zeros((0, width))
            for part in parts:
                r = triangle([r, np.stack([c.to_numpy() for c in part.columns], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

        found = table.select(*self.columns).mapInArrow(reduce, "r binary").rdd
        one = found.map(lambda row: np.frombuffer(row[0]).reshape(-1, width)).treeReduce(lambda a, b: triangle([a, b]), depth=3)
        return triangle([np.zeros((0, width)), one])

    def _orthonormal(self, table: DataFrame) -> DataFrame:
        turn = inverse(self._triangle(table))
        return self._written(self._mapped(table, "i", self.columns, lambda _, v: v @ turn), "block")

    def iterate(self) -> np.ndarray:
        sums = [F.sum(F.col("w") * F.col(c)).alias(c) for c in self.columns]
        self.y = self._written(self.entries.join(self.block, "i").groupBy(self.key).agg(*sums), "rows")
        self.r = self._triangle(self.y)
        self.last = self.block
        z = self._written(self.entries.join(self.y, self.key).groupBy("i").agg(*sums), "terms")
        turn = inverse(self.r)
        self.block = self._orthonormal(self._written(self._mapped(z, "i", self.columns, lambda _, v: v @ turn), "block"))
        return self.r

    def finish(self, k: int, rounds: int) -> Svd:
        _, values, vt = np.linalg.svd(self.r)
        turn = np.zeros((self.width, self.width))
        turn[:, :k] = vt[:k].T
        loadings = self._written(self._mapped(self.last, "i", self.columns, lambda _, v: v @ turn), "loadings")
        chosen = self.columns[:k]
        # of each vector the loading that is largest without its sign, of equals the first term's
        signs = loadings.agg(
            *[F.max_by(F.signum(c), F.struct(F.abs(F.col(c)), -F.col("i"))).alias(c) for c in chosen]
        ).first()
        flips = [-1.0 if signs[c] is not None and signs[c] < 0 else 1.0 for c in chosen]
        scores = self._mapped_scores(turn)
        flip = lambda df, by, name: df.select(by, F.array(*[F.col(c) * f for c, f in zip(chosen, flips)]).alias(name))
        zeros = F.array(*[F.lit(0.0)] * k)
        whole = self.rows.select(self.key).join(flip(scores, self.key, "scores"), self.key, "left")
        whole = whole.select(self.key, F.coalesce("scores", zeros).alias("scores"))
        return Svd(values[:k], whole, flip(loadings, "i", "loadings"), rounds)

    def _mapped_scores(self, turn: np.ndarray) -> DataFrame:
        return self._mapped(self.y, self.key, self.columns, lambda _, v: v @ turn)
