"""Logistic regression by Newton's method on aggregates, with a certificate of the optimum.

A step is one pass over the rows: the loss, its gradient and its Hessian are sums that tasks make
in blocks of an array, so what leaves a task grows with the square of the features and not with the rows.
The driver solves a system of one row per feature. The objective is that of ``models.logistic``:
mean loss of standardised features plus half the penalty times the squared coefficients, the
intercept free. It is strictly convex, so a gradient of zero proves that a fit is the best one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators.models import align

INTERCEPT = "intercept"


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients of standardised features and, last, the intercept, with what proves them."""

    features: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    gradient: tuple[float, ...]
    #: least eigenvalue of the Hessian at the fit
    curvature: float
    n_rows: int
    #: objective at the start and after each step
    losses: tuple[float, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per term: mean, deviation (0 and 1 for the intercept), weight, gradient, curvature."""
        terms = zip((*self.features, INTERCEPT), (*self.centre, 0.0), (*self.scale, 1.0), self.weights, self.gradient)
        rows = [(*term, self.curvature, self.n_rows) for term in terms]
        return spark.createDataFrame(
            rows, "term string, mean double, deviation double, weight double, gradient double, curvature double, n_rows long"
        )


def _derivatives(
    rows: DataFrame, centre: Sequence[float], scale: Sequence[float], weights: np.ndarray, n: int, penalty: float
) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian at ``weights`` in one pass over ``rows``: y and the features."""
    k = len(weights)
    upper = np.triu_indices(k)

    def sums(batches):
        import pyarrow as pa

        found = np.zeros(1 + k + len(upper[0]))
        for batch in batches:
            y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.ones((len(y), k))
            for i, c in enumerate(columns):
                x[:, i] = (c - centre[i]) / scale[i]
            z = x @ weights
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            found[0] += (np.logaddexp(0, z) - y * z).sum()
            found[1 : 1 + k] += (p - y) @ x
            found[1 + k :] += ((x * (p * (1 - p))[:, None]).T @ x)[upper]
        columns = [pa.array(range(len(found)), pa.int32()), pa.array(found, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "part"])

    # a row per sum from each task, added up before they reach the driver
    parts = rows.mapInArrow(sums, "at int, part double").groupBy("at").agg(F.sum("part"))
    total = np.zeros(1 + k + len(upper[0]))
    for at, value in parts.collect():
        total[at] = value / n
    free = np.append(np.ones(k - 1), 0.0) * penalty
    hessian = np.zeros((k, k))
    hessian[upper] = total[1 + k :]
    hessian = hessian + np.triu(hessian, 1).T + np.diag(free)
    return total[0] + float(free @ weights**2) / 2, total[1 : 1 + k] + free * weights, hessian


def fit_logistic(
    rows: DataFrame,
    features: Sequence[str],
    label: str = "reordered",
    penalty: float | None = None,
    tolerance: float = 1e-9,
    max_steps: int = 60,
) -> LogisticFit:
    """Fit on all ``rows``, read once per step: pass a written or persisted table.

    ``penalty`` is one divided by the rows unless given. Null features, and those the rows lack,
    count as 0; rows without a label are left out; a constant feature gets a coefficient of 0.
    Raises ValueError without rows of both labels, and where the gradient is not below
    ``tolerance`` after ``max_steps``.
    """
    known = align(rows.filter(F.col(label).isNotNull()), features, [label])
    known = known.withColumn("y", F.col(label).cast("double")).select("y", *features)
    moments = known.agg(
        F.count("*").alias("n"),
        F.sum("y").alias("ones"),
        *(F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)),
        *(F.stddev_samp(f).alias(f"s_{i}") for i, f in enumerate(features)),
    ).first()
    n = moments["n"]
    if not n or not 0 < moments["ones"] < n:
        raise ValueError("a fit needs rows of both labels")
    centre = [float(moments[f"m_{i}"]) for i in range(len(features))]
    scale = [float(moments[f"s_{i}"] or 0.0) or 1.0 for i in range(len(features))]
    penalty = 1.0 / n if penalty is None else penalty
    share = moments["ones"] / n
    weights = np.append(np.zeros(len(features)), np.log(share / (1 - share)))
    loss, gradient, hessian = _derivatives(known, centre, scale, weights, n, penalty)
    losses = [loss]
    for _ in range(max_steps):
        if np.abs(gradient).max() <= tolerance:
            break
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while True:
            tried = _derivatives(known, centre, scale, weights - size * step, n, penalty)
            # near the optimum the decrease is below the rounding of the sums
            if tried[0] <= loss - 1e-4 * size * float(gradient @ step) + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        weights = weights - size * step
        loss, gradient, hessian = tried
        losses.append(loss)
    else:
        if np.abs(gradient).max() > tolerance:
            raise ValueError(f"no optimum after {max_steps} steps: largest gradient {np.abs(gradient).max():.2e}")
    return LogisticFit(
        tuple(features),
        tuple(centre),
        tuple(scale),
        tuple(float(w) for w in weights),
        tuple(float(g) for g in gradient),
        float(np.linalg.eigvalsh(hessian)[0]),
        n,
        tuple(losses),
    )


def predict_logistic(fit: LogisticFit, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, the class and the probability of a reorder of every row, as expressions."""
    terms = zip(fit.features, fit.centre, fit.scale, fit.weights)
    z = sum(((F.col(f) - c) / s * w for f, c, s, w in terms), F.lit(fit.weights[-1]))
    scored = align(df, fit.features, keep).select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("reorder_probability"))
    return scored.select(*keep, (F.col("reorder_probability") > 0.5).cast("int").alias("prediction"), "reorder_probability")
