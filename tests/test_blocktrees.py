from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from cartloom.operators import blocktrees as T
from cartloom.operators import evaluate as E
from cartloom.operators import models as M
from cartloom.plans.data import Data

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    """More rows than Spark looks at for its cuts; zeros, few values, and a feature that is constant."""
    rows = spark.range(12_000, numPartitions=3).selectExpr(
        "id user_id", "id % 7 product_id", "rand(1) a", "IF(id % 3 = 0, 0, randn(2)) b", "CAST(id % 4 AS DOUBLE) c", "1.5D d", "-rand(3) e"
    )
    return rows.withColumn("reordered", F.expr("int(3 * a + 0.4 * c + b + randn(4) > 2.3)")).persist()


def nodes_of(spark, model, path):
    model.write().overwrite().save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees = {}
    for t in {r["treeID"] for r in found}:
        own = {r["id"]: r for r in found if r["treeID"] == t}
        todo, trees[t] = [0], []
        for i in todo:
            trees[t].append(own[i])
            todo += [own[i]["leftChild"], own[i]["rightChild"]] if own[i]["leftChild"] >= 0 else []
    return trees


def test_boosting_on_blocks_finds_the_trees_of_spark(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "KEPT_BYTES", 0)
    monkeypatch.setattr(T, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(T, "LEAST_ROWS", 3000)
    monkeypatch.setattr(T, "CHUNK", 2000)
    pipeline = M.boosted(FEATURES, 5, 3)
    assert isinstance(pipeline.getStages()[-1], T.BlockGBTClassifier)
    plain = GBTClassifier(labelCol="reordered", maxIter=5, maxDepth=3, stepSize=0.1, seed=M.SEED)
    own, other = (M.fit(p, table) for p in (pipeline, Pipeline(stages=[pipeline.getStages()[0], plain])))
    assert own.stages[-1].treeWeights == other.stages[-1].treeWeights
    found, expected = (nodes_of(spark, m.stages[-1], f"{tmp_path}/{i}") for i, m in enumerate((own, other)))
    assert found.keys() == expected.keys()
    for t in expected:
        assert len(found[t]) == len(expected[t])
        for a, b in zip(found[t], expected[t]):
            assert a["split"] == b["split"] and a["rawCount"] == b["rawCount"]
            for k in ("prediction", "impurity", "gain"):
                assert a[k] == pytest.approx(b[k], abs=1e-7)
            assert a["impurityStats"] == pytest.approx(b["impurityStats"], abs=1e-3)
    keys = ["user_id", "product_id"]
    both = M.predict(own, table, keys).join(M.predict(other, table, keys).withColumnRenamed("reorder_probability", "o"), keys)
    assert both.filter("abs(reorder_probability - o) > 1e-7").count() == 0
    assert both.count() == 12_000


def test_trees_do_not_depend_on_the_tasks(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "KEPT_BYTES", 0)
    small = table.filter("user_id < 3000")
    found = []
    for i, (rows, direct) in enumerate(((20_000, 64), (500, 64), (500, 2))):
        monkeypatch.setattr(T, "LEAST_ROWS", rows)
        monkeypatch.setattr(T, "DIRECT", direct)
        found.append(M.fit(M.boosted(FEATURES, 3, 3), small).stages[-1].toDebugString.split("\n", 1)[1])
    assert found[0] == found[1] == found[2]


def test_forest_on_blocks(spark, table, monkeypatch, tmp_path):
    pipeline = M.forest(FEATURES, 24, 5)
    plain = RandomForestClassifier(labelCol="reordered", numTrees=24, maxDepth=5, seed=M.SEED)
    other = M.fit(Pipeline(stages=[pipeline.getStages()[0], plain]), table)
    assert M.fit(pipeline, table).stages[-1].toDebugString.split("\n", 1)[1] == other.stages[-1].toDebugString.split("\n", 1)[1]
    monkeypatch.setattr(T, "KEPT_BYTES", 0)
    monkeypatch.setattr(T, "GROUP", 10)
    monkeypatch.setattr(T, "FOREST_BLOCK", 1000)
    own = M.fit(pipeline, table)
    trees = nodes_of(spark, own.stages[-1], f"{tmp_path}/forest")
    assert len(trees) == 24 and len({tuple(map(str, t)) for t in trees.values()}) == 24
    for t in trees.values():
        # a bootstrap sample is about as large as the table, and children share their parent's rows
        assert 11_400 < t[0]["rawCount"] < 12_600
        by_id = {r["id"]: r for r in t}
        for r in t:
            assert r["rawCount"] == sum(r["impurityStats"])
            if r["leftChild"] >= 0:
                below = [by_id[r[k]]["impurityStats"] for k in ("leftChild", "rightChild")]
                assert [x + y for x, y in zip(*below)] == r["impurityStats"] and r["gain"] > 0
            assert r["split"]["featureIndex"] != 3  # the constant one
    areas = [E.roc_auc(M.predict(m, table), "reordered", "reorder_probability").first()[0] for m in (own, other)]
    assert areas[0] == pytest.approx(areas[1], abs=0.02)
    assert own.stages[-1].totalNumNodes == pytest.approx(other.stages[-1].totalNumNodes, rel=0.2)
    again = M.fit(pipeline, table)
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == own.stages[-1].toDebugString.split("\n", 1)[1]


def test_odd_rows_are_refused(table, monkeypatch):
    monkeypatch.setattr(T, "KEPT_BYTES", 0)
    with pytest.raises(Exception, match="label must be 0 or 1"):
        M.fit(M.boosted(FEATURES, 2, 2), table.withColumn("reordered", F.col("reordered") * 2))
    with pytest.raises(Exception, match="finite"):
        M.fit(M.boosted(FEATURES, 2, 2), table.withColumn("a", F.lit(float("inf"))))
    one_class = M.fit(M.boosted(FEATURES, 2, 2), table.withColumn("reordered", F.lit(0)))
    assert one_class.stages[-1].totalNumNodes == 2


def test_small_tables_are_fitted_by_spark():
    boosted, forest = (p.getStages()[-1] for p in (M.boosted(FEATURES), M.forest(FEATURES)))
    assert not boosted.by_blocks(2_000_000) and boosted.by_blocks(12_000_000)
    assert not forest.by_blocks(200_000) and forest.by_blocks(2_000_000)


def test_scores_of_all_pairs_are_written_once(spark, table, monkeypatch):
    """``model_learns`` reads them several times."""
    model, asked = M.fit(M.forest(FEATURES, 3, 2), table), []
    monkeypatch.setattr(Data, "model", lambda self, name: asked.append(name) or model)
    monkeypatch.setattr(Data, "split_matrix", table.withColumn("split", F.lit("train")))
    d = Data(spark, "scores written once")
    scored = [d.pair_scores("forest") for _ in range(2)]
    assert asked == ["forest"] and scored[0].inputFiles()
    assert scored[1].columns == ["reordered", "prediction", "reorder_probability"] and scored[1].count() == 12_000
