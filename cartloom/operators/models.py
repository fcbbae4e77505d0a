"""Reorder classifiers on the labelled matrix with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.blocktrees import ROW_BYTES, TREE_BYTES, BlockForestClassifier, BlockGBTClassifier
from cartloom.operators.evaluate import accuracy, precision_recall_at_k, roc_auc
from cartloom.operators.features import (
    SERVING_FEATURES,
    labelled,
    serving_matrix,
)
from cartloom.operators.sampling import hash_split
from cartloom.schemas import KEY_COLUMNS

SEED = 42
#: What the rows of one task take in memory while Spark fits a model, by ``ROW_BYTES`` a row of features;
#: a forest adds a count and a node per tree.
TASK_BYTES = 128 << 20


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but keys and label."""
    return [c for c in df.columns if c not in KEY_COLUMNS]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and then exactly ``features`` in order, absent ones and nulls as 0."""
    columns = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        if c in df.columns
        else F.lit(0.0).alias(c)
        for c in features
    ]
    return df.select(*keep, *columns)


def labelled_serving_matrix(
    orders: DataFrame,
    prior: DataFrame,
    train: DataFrame,
    by_product: DataFrame | None = None,
    totals: DataFrame | None = None,
    buckets: int = 0,
) -> DataFrame:
    """The 12 serving features from prior orders only, labelled by the train order.

    The held-out order gives labels and nothing else. ``by_product`` and ``totals`` may pass staged
    ``product_features`` and ``pair_totals``, the latter in ``buckets`` by user.
    """
    past = orders.filter(F.col("eval_set") == "prior")
    last = orders.filter(F.col("eval_set") == "train").select("user_id", "order_id")
    pairs = serving_matrix(past, prior, by_product, totals, buckets).join(last, "user_id")
    return labelled(pairs, last, train).select("user_id", "product_id", "order_id", *SERVING_FEATURES, "reordered")


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def logistic(features: Sequence[str], n_rows: int, max_iter: int = 1000) -> Pipeline:
    """Scaled logistic regression; the penalty equals an inverse strength of 1."""
    return Pipeline(
        stages=[
            _assembler(features, "raw_features"),
            StandardScaler(
                inputCol="raw_features", outputCol="features", withMean=True, withStd=True
            ),
            LogisticRegression(
                labelCol="reordered",
                maxIter=max_iter,
                regParam=1.0 / max(n_rows, 1),
                standardization=False,
            ),
        ]
    )


def forest(features: Sequence[str], trees: int = 100, depth: int = 10, seed: int = SEED) -> Pipeline:
    """Random forest."""
    return Pipeline(
        stages=[
            _assembler(features),
            BlockForestClassifier(
                labelCol="reordered",
                numTrees=trees,
                maxDepth=depth,
                seed=seed,
                cacheNodeIds=True,
                checkpointInterval=10,
            ),
        ]
    )


def boosted(
    features: Sequence[str],
    rounds: int = 200,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = SEED,
) -> Pipeline:
    """Gradient-boosted trees.

    Where Spark fits them itself, lineage is cut in the checkpoint folder every 10 rounds, and rows walk down
    the few levels of a tree: keeping their nodes costs a pass and a checkpoint a level.
    """
    return Pipeline(
        stages=[
            _assembler(features),
            BlockGBTClassifier(
                labelCol="reordered",
                maxIter=rounds,
                maxDepth=depth,
                stepSize=rate,
                seed=seed,
                cacheNodeIds=False,
                checkpointInterval=10,
            ),
        ]
    )


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit over all rows; ``train`` should be a written table or persisted.

    Features are aligned first, so a column the data lacks counts as 0. Rows are dealt to more tasks
    where those that read them would hold more than ``TASK_BYTES`` each; tasks that pack their rows into
    blocks hold few, and only have to keep all cores busy.
    """
    rows = align(train, model_features(pipeline), ["reordered"])
    n_rows, last = train.count(), pipeline.getStages()[-1]
    tasks = fit_tasks(pipeline, n_rows)
    if isinstance(last, BlockForestClassifier | BlockGBTClassifier) and last.by_blocks(n_rows):
        tasks = min(tasks, train.sparkSession.sparkContext.defaultParallelism)
    return pipeline.fit(rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows)


def fit_tasks(pipeline: Pipeline, n_rows: int) -> int:
    """Tasks that hold at most ``TASK_BYTES`` of ``n_rows`` rows while the pipeline is fitted."""
    last = pipeline.getStages()[-1]
    trees = last.getNumTrees() if isinstance(last, RandomForestClassifier) else 0
    return -(-n_rows * (ROW_BYTES + TREE_BYTES * trees) // TASK_BYTES)


def model_features(model: Pipeline | PipelineModel) -> list[str]:
    """Feature names in the order the model expects."""
    stages = model.stages if isinstance(model, PipelineModel) else model.getStages()
    return stages[0].getInputCols()


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Class and probability of a reorder for every row."""
    keep = [c for c in df.columns if c in KEY_COLUMNS] if keep is None else list(keep)
    out = model.transform(align(df, model_features(model), keep))
    return out.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("reorder_probability"),
    )


def quality(name: str, scored: DataFrame) -> DataFrame:
    """Accuracy and ROC-AUC of scored rows as (model, metric, value)."""
    parts = (
        accuracy(scored, "reordered", "reorder_probability"),
        roc_auc(scored, "reordered", "reorder_probability"),
    )
    rows = [
        p.select(F.lit(name).alias("model"), F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("value"))
        for p in parts
    ]
    return rows[0].unionByName(rows[1])


def compare(
    matrix: DataFrame,
    features: Sequence[str] = SERVING_FEATURES,
    k: int = 10,
    max_iter: int = 1000,
    trees: int = 100,
    tree_depth: int = 10,
    rounds: int = 200,
    boost_depth: int = 6,
) -> DataFrame:
    """Train all three on 80 % of the pairs, report accuracy and AUC on the rest.

    Adds precision and recall at ``k`` of the boosted model. ``matrix`` is read by every
    model, so pass a written table.
    """
    split = hash_split(matrix)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    train = train.persist()
    try:
        pipelines = {
            "logistic": logistic(features, train.count(), max_iter),
            "forest": forest(features, trees, tree_depth),
            "boosted": boosted(features, rounds, boost_depth),
        }
        models = {name: fit(p, train) for name, p in pipelines.items()}
    finally:
        train.unpersist()
    return compare_scores({name: predict(m, test) for name, m in models.items()}, k)


def compare_scores(scored: dict[str, DataFrame], k: int = 10, best: str = "boosted") -> DataFrame:
    """Accuracy and AUC of each model's scored rows, and precision and recall at ``k`` of the
    ``best`` one. Each table is read several times, so pass written ones."""
    rows = [quality(name, s) for name, s in scored.items()]
    at_k = precision_recall_at_k(
        scored[best], scored[best].withColumnRenamed("reorder_probability", "score"), k
    )
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision_at_k", "recall_at_k")]
    rows.append(at_k.select(F.lit(best).alias("model"), F.inline(F.array(*metrics))))
    return reduce(DataFrame.unionByName, rows)
