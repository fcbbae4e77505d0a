"""Quality rules and robust multivariate outliers.

A document fails the base rules with fewer than 50 words or when over half of its words lie in
3-word windows that the text repeats. The others are judged by a vector of transformed
statistics. For each language and source the minimum-covariance-determinant estimate gives the
center and shape of the closest half of its vectors, reweighted with all rows within the
``NEAR`` quantile; both shapes are scaled to what normal vectors would show. A document is
rejected when its squared Mahalanobis distance exceeds ``CUTOFF``, the chi-squared quantile of
``QUANTILE``.

The statistics are square roots of shares and a logarithm of a mean, so a document of n units
shows each with an error variance near 1 / 4n whatever the group is like. The mean of these
errors over all rows is the least variance in the estimates, and at the end each document is
held against the spread between documents plus its own error: long texts are judged more
sharply than short ones. Repeats come by lines, so both of their statistics count lines.

The estimate is found by concentration steps over all rows, as aggregates: distances under the
current estimate, their quantile within the group, moments of the rows below it. Two starts are
followed, from medians and from means; the smaller determinant wins. Groups are never gathered:
only their moments are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.common import staged

STATISTICS = ("s_length", "s_symbols", "s_marks", "s_upper", "s_lines", "s_repeat")
P = len(STATISTICS)
#: What each statistic counts.
UNITS = ("n_words", "n_words", "n_words", "word_chars", "lines", "lines")
SHARE = 0.5
NEAR = 0.975
QUANTILE = 0.999
STEPS = 4
#: Groups with fewer rows are judged by the estimate of all rows of their language, and those
#: of languages with fewer by that of all rows.
LEAST_ROWS = 60


def chi2_share(x: float, freedom: int) -> float:
    """Chi-squared distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(freedom // 2))


def chi2_quantile(share: float, freedom: int = P) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, freedom) < share else (low, middle)
    return low


def consistency(share: float) -> float:
    """Covariance of normal vectors over that of the closest ``share`` of them."""
    return share / chi2_share(chi2_quantile(share), P + 2)


CUTOFF = chi2_quantile(QUANTILE)

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()) + _SPACES.encode()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and, for the vector, lines with a word, upper-case ASCII letters, ASCII
    letters and digits and other characters, and ASCII marks."""
    if not text:
        return (0,) * 9
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marks = len(raw.translate(None, _PLAIN))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, marks, len(raw)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``key``, the columns ``by``, ``COUNTS``, lines and ``STATISTICS`` of every row; a null
    text has no words."""
    names = [*COUNTS, "lines", "upper", "marks", "bytes"]

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            rows = [measure(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *names])

    kept = [key, *by]
    source = docs.select(*kept, F.col(text).alias("__text"))
    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(c) for c in names]).schema
    counted = source.mapInArrow(run, schema)
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        *kept,
        *COUNTS,
        "lines",
        F.log((F.col("word_chars") + 1) / n).alias("s_length"),
        F.sqrt(F.col("n_symbols") / n).alias("s_symbols"),
        F.sqrt(F.greatest(F.col("marks") - F.col("n_symbols"), F.lit(0)) / n).alias("s_marks"),
        F.sqrt(F.col("upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("s_upper"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("lines"), F.lit(1))).alias("s_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("s_repeat"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _squared_distance(center: str = "center", inverse: str = "inverse") -> Column:
    d = [f"({s} - {center}[{i}])" for i, s in enumerate(STATISTICS)]
    terms = [f"{2 if i < j else 1} * {d[i]} * {d[j]} * {inverse}[{i * P + j}]" for i in range(P) for j in range(i, P)]
    return F.expr(" + ".join(terms))


def _errors() -> list[Column]:
    return [0.25 / F.greatest(F.col(u), F.lit(1)) for u in UNITS]


def _estimates(moments: DataFrame, factor: float = 1.0, error: tuple[float, ...] = (0.0,) * P) -> DataFrame:
    """Center, inverse and log-determinant from the moments of each group and start, and the
    covariance without ``error``, the least variance of each statistic."""

    def run(parts):
        for frame in parts:
            rows = []
            for g, start, n, sums, products in frame[["grp", "start", "n", "sums", "products"]].itertuples(index=False):
                mean = np.array(sums, float) / n
                cov = np.zeros((P, P))
                cov[np.triu_indices(P)] = np.array(products, float) / n
                cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * factor
                cov = cov + np.diag(np.maximum(np.array(error) - np.diag(cov), 0) + 1e-9)
                sizes, axes = np.linalg.eigh(cov - np.diag(error))
                between = (axes * np.maximum(sizes, 0)) @ axes.T
                logdet = float(np.linalg.slogdet(cov)[1])
                rows.append((g, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), logdet, between.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["grp", "start", "center", "inverse", "logdet", "between"])

    schema = "grp string, start int, center array<double>, inverse array<double>, logdet double, between array<double>"
    return moments.mapInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def _own_distance(vector: pd.Series, error: pd.Series, center: pd.Series, between: pd.Series) -> pd.Series:
    """Squared distance under the spread between documents and each row's own error."""
    d = np.stack(vector) - np.stack(center)
    cov = np.stack(between).reshape(-1, P, P) + np.stack(error)[:, :, None] * np.eye(P)
    return pd.Series(np.einsum("ij,ij->i", d, np.linalg.solve(cov, d[..., None])[..., 0]))


def _moments(rows: DataFrame) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(STATISTICS) for b in STATISTICS[i:]]
    return rows.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(s) for s in STATISTICS]).alias("sums"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("products"),
    )


def _grouped(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``grp``, whose estimate judges a row: all of ``by``, else the first of
    them, else all rows; and ``fits``, the groups whose estimates it enters. An estimate of a
    language or of all is fitted, on all their rows, only when a small group needs it."""
    name = lambda kind, *c: F.concat_ws("\x01", F.lit(kind), *[F.coalesce(F.col(x).cast("string"), F.lit("\x02")) for x in c])
    rows = rows.withColumn("__full", name("full", *by))
    sizes = rows.groupBy("__full", name("first", by[0]).alias("__first")).agg(F.sum((~F.col("failed")).cast("long")).alias("n"))
    firsts = sizes.groupBy("__first").agg(F.sum("n").alias("pool"), F.min("n").alias("least"))
    grp = F.when(F.col("n") >= LEAST_ROWS, F.col("__full")).when(F.col("pool") >= LEAST_ROWS, F.col("__first")).otherwise(F.lit("all"))
    chosen = staged(sizes.join(firsts, "__first").withColumn("grp", grp), "groups")
    fits = [
        F.when(F.col("n") >= LEAST_ROWS, F.col("__full")),
        F.when((F.col("least") < LEAST_ROWS) & (F.col("pool") >= LEAST_ROWS), F.col("__first")),
    ]
    if chosen.filter("grp = 'all'").head(1):
        fits.append(F.lit("all"))
    chosen = chosen.select("__full", "grp", F.array_compact(F.array(*fits)).alias("fits"))
    return rows.join(chosen, "__full").drop("__full")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``COUNTS``, base_failed, distance (squared,
    robust; null where the base rules failed), kept.

    Null languages and sources are groups of their own, a null text fails the base rules, a
    table with fewer than ``LEAST_ROWS`` rows is judged by its own estimate,
    repeated rows count each time, an empty table gives an empty one.
    """
    rows = staged(statistics(docs, key, text, by).withColumn("failed", base_failed()), "statistics")
    rows = staged(_grouped(rows, by), "grouped")
    fit = rows.filter("NOT failed").select(F.explode("fits").alias("grp"), *STATISTICS)
    quartiles = fit.groupBy("grp").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATISTICS])
    error = rows.filter("NOT failed").agg(*[F.coalesce(F.avg(e), F.lit(0.25)) for e in _errors()]).first()
    error = tuple(error)  # one row
    spread = [f"greatest(pow(({s}[2] - {s}[0]) / 1.349, 2), {e!r}D)" for s, e in zip(STATISTICS, error)]
    medians = quartiles.select(
        "grp",
        F.lit(0).alias("start"),
        F.array(*[F.col(s)[1] for s in STATISTICS]).alias("center"),
        F.array(*[F.expr(f"1 / {spread[i]}") if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse"),
        F.lit(0.0).alias("logdet"),
        F.array().cast("array<double>").alias("between"),
    )
    means = _estimates(_moments(fit.withColumn("start", F.lit(1))), error=error)
    estimates = staged(medians.union(means), "estimates")
    for _ in range(STEPS):
        near = fit.join(estimates, "grp").withColumn("d", _squared_distance())
        bounds = near.groupBy("grp", "start").agg(F.percentile_approx("d", SHARE, 2000).alias("bound"))
        bounds = staged(estimates.join(bounds, ["grp", "start"]), "bounds")
        core = fit.join(bounds, "grp").filter(_squared_distance() <= F.col("bound"))
        estimates = staged(_estimates(_moments(core), consistency(SHARE), error), "estimates")
    best = estimates.groupBy("grp").agg(F.min_by(F.struct("center", "inverse"), F.struct("logdet", "start")).alias("best"))
    best = staged(best.select("grp", "best.*", F.lit(0).alias("start")), "best")
    # never empty: over the closest half the mean of the distances is below P
    near = fit.join(best, "grp").filter(_squared_distance() <= chi2_quantile(NEAR))
    best = _estimates(_moments(near), consistency(NEAR), error).select("grp", "center", "between")
    judged = rows.join(staged(best, "judges"), "grp", "left")
    held = judged.withColumns({"vector": F.array(*STATISTICS), "error": F.array(*_errors())})
    passed = held.filter("NOT failed").withColumn("distance", _own_distance("vector", "error", "center", "between"))
    judged = passed.unionByName(held.filter("failed").withColumn("distance", F.lit(None).cast("double")))
    return judged.select(
        key,
        *COUNTS,
        F.col("failed").alias("base_failed"),
        "distance",
        (~F.col("failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))).alias("kept"),
    )
