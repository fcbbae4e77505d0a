from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cartloom.operators import boosting as B
from cartloom.operators import evaluate as E
from cartloom.operators import models as M
from cartloom.sources.stage import scratch_path

FEATURES = ["a", "b", "c"]


def made(n: int, seed: int = 1) -> list[tuple]:
    """Labels that follow two of three features; one has few values, one many."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.random(), float(r.randrange(4)), r.gauss(0, 1)
        out.append((i, i, a, b, c, int(3 * a + 0.6 * b + r.gauss(0, 0.7) > 2.4)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(900), "user_id long, product_id long, a double, b double, c double, reordered int")


def plain_tree(rows, margins, cuts, depth, rate, least=1.0):
    """One tree by trying every cut of every node: {node: (feature, cut) or weight}."""
    p = [1 / (1 + math.exp(-m)) for m in margins]
    g = [round((q - r[-1]) * 2**24) / 2**24 for q, r in zip(p, rows)]
    h = [round(q * (1 - q) * 2**24) / 2**24 for q in p]
    tree, open_nodes = {}, [(0, list(range(len(rows))), 0)]
    while open_nodes:
        node, own, level = open_nodes.pop()
        total_g, total_h = sum(g[i] for i in own), sum(h[i] for i in own)
        best = None
        for f in range(len(FEATURES)) if level < depth else ():
            for cut in cuts[f]:
                left = [i for i in own if rows[i][2 + f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gr, hr = total_g - gl, total_h - hl
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - total_g * total_g / (total_h + 1)
                if hl >= least and hr >= least and gain > (best[0] if best else 0):
                    best = (gain, f, cut, left)
        if best is None:
            tree[node] = -total_g / (total_h + 1) * rate
            for i in own:
                margins[i] += tree[node]
        else:
            tree[node] = (FEATURES[best[1]], best[2])
            inside = set(best[3])
            open_nodes += [(2 * node + 1, best[3], level + 1), (2 * node + 2, [i for i in own if i not in inside], level + 1)]
    return tree


def test_trees_equal_plain_code(spark, table):
    rows, bins = made(900), 8
    cuts = []
    for f in range(3):
        values = sorted(r[2 + f] for r in rows)
        cuts.append(sorted({values[k * len(values) // bins] for k in range(1, bins)} - {values[-1]}))
    assert B.quantile_cuts(table, FEATURES, bins) == cuts
    model = B.fit_newton(table, FEATURES, rounds=3, depth=3, bins=bins, rate=0.3)
    margins = [0.0] * len(rows)
    expected = [plain_tree(rows, margins, cuts, 3, 0.3) for _ in range(3)]
    got = [{} for _ in range(3)]
    for r in model.nodes(spark).collect():
        got[r["round"]][r["node"]] = r["weight"] if r["feature"] is None else (r["feature"], r["cut"])
    for found, plain in zip(got, expected):
        assert found.keys() == plain.keys()
        for node, value in plain.items():
            assert found[node] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value)
    values = np.array([r[2:5] for r in rows])
    assert np.allclose(model.margins(values), margins)


def test_trees_do_not_depend_on_the_partitions(table, monkeypatch):
    fits = []
    for parts, direct in ((1, 64), (7, 64), (13, 4)):
        monkeypatch.setattr(B, "DIRECT", direct)
        fits.append(B.fit_newton(table.repartition(parts), FEATURES, rounds=3, depth=3))
    for other in fits[1:]:
        for k in ("feature", "cut", "weight", "gain"):
            assert (getattr(other, k) == getattr(fits[0], k)).all()


def test_loss_falls_and_ranks_as_well_as_first_order_boosting(spark, table, monkeypatch):
    monkeypatch.setattr(B, "KEEP_ROUNDS", 4)  # margins pass through files
    model = B.fit_newton(table, FEATURES, rounds=10, depth=3, rate=0.2)
    rows = made(900)
    values, y = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows])
    losses = []
    for k in range(11):
        part = B.BoostedTrees(FEATURES, model.feature[:k], model.cut[:k], model.weight[:k], model.gain[:k])
        m = part.margins(values)
        losses.append(float(np.mean(np.logaddexp(0, m) - y * m)))
    assert all(b < a for a, b in zip(losses, losses[1:]))
    unseen = spark.createDataFrame(made(3000, seed=2), table.schema)
    scored = B.predict_newton(model, unseen)
    assert scored.columns == ["user_id", "product_id", "reordered", "prediction", "reorder_probability"]
    own = E.roc_auc(scored, "reordered", "reorder_probability").first()[0]
    first_order = M.predict(M.fit(M.boosted(FEATURES, 10, 3, 0.2), table), unseen)
    assert own >= E.roc_auc(first_order, "reordered", "reorder_probability").first()[0] - 0.005
    path = scratch_path(spark, "trees")
    model.save(spark, path)
    again = B.predict_newton(B.BoostedTrees.load(spark, path), unseen)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_edges(spark, table):
    nulls = table.selectExpr("user_id", "product_id", "IF(user_id % 9 = 0, NULL, a) AS a", "reordered")
    model = B.fit_newton(nulls, FEATURES, rounds=2, depth=2)  # b and c are absent: 0
    assert set(model.feature[model.feature >= 0].tolist()) == {0}
    assert B.predict_newton(model, nulls).count() == 900
    one_class = B.fit_newton(table.withColumn("reordered", table.reordered * 0), FEATURES, rounds=2, depth=2)
    assert (one_class.feature < 0).all() and (one_class.weight[:, 0] < 0).all()
    with pytest.raises(ValueError, match="no rows"):
        B.fit_newton(table.limit(0), FEATURES)
    with pytest.raises(ValueError, match="bins"):
        B.fit_newton(table, FEATURES, bins=300)


def test_of_two_children_one_is_summed(table, monkeypatch):
    """A level reads the rows of at most one child of each split, and the trees stay the same."""
    asked = []
    real = B._summed

    def summed(blocks, tree, level, nodes, *rest):
        asked.append((level, list(nodes)))
        return real(blocks, tree, level, nodes, *rest)

    monkeypatch.setattr(B, "_summed", summed)
    B.fit_newton(table, FEATURES, rounds=2, depth=3, bins=16)
    assert [level for level, _ in asked] == [0, 1, 2] * 2
    for _, nodes in asked:
        assert len({(n - 1) // 2 for n in nodes}) == len(nodes)


def test_blocks_are_filled_over_arrow_batches(spark):
    n = B.BLOCK + 20_000
    rows = spark.range(n, numPartitions=1).selectExpr("id * 1.0D a", "int(id % 2) reordered")
    found = B._blocks(rows, ["a"], "reordered", [[29_999.0]]).collect()
    assert [r["n"] for r in found] == [B.BLOCK, 20_000]
    binned = np.concatenate([np.frombuffer(r["bins"], np.uint8) for r in found])
    assert binned.tolist() == [0] * 30_000 + [1] * (n - 30_000)
