"""The distributed forest: tops, cells and scores against one tree grown in plain Python."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from subsight.operators import forest, models
from subsight.operators.forest import LEAF, CellForest


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    found = []
    for i in range(400):
        x = [rng.random(), float(rng.randrange(3)), rng.random(), float(i % 50 == 0)]
        found.append((i, float(rng.random() < (0.8 if x[0] > 0.5 and x[1] > 0 else 0.2)), x))
    df = spark.createDataFrame(found, "subid long, churn double, f array<double>")
    return df.select("subid", "churn", array_to_vector("f").alias("features")).repartition(3).cache()


def fitted(rows, **settings):
    return CellForest(labelCol="churn", **{"numTrees": 4, "maxDepth": 8, "featureSubsetStrategy": "all", **settings}).fit(rows)


def plain_best(x, y, w):
    """Gain of the best split by trying all."""
    def gini(m):
        n, p = w[m].sum(), w[m & (y == 1)].sum()
        return 0.0 if n == 0 else 2 * p / n * (1 - p / n)

    everyone = np.ones(len(x), bool)
    best = 0.0
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f]):
            left = x[:, f] <= c
            n, a, b = w.sum(), w[left].sum(), w[~left].sum()
            if a and b:
                best = max(best, gini(everyone) - a / n * gini(left) - b / n * gini(~left))
    return best


def test_the_best_split_is_the_best_of_all(rows):
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 9, (200, 3)).astype(np.uint8), rng.integers(0, 2, 200), rng.integers(1, 4, 200).astype(np.uint8)
    nodes = forest.grow_cell(x, y, w, 0, (1, 2, 3), 1, 3, "gini")
    assert nodes.rows["gain"].max() == pytest.approx(plain_best(x, y, w))


def test_cells_and_tops_do_not_change_what_is_grown(rows, monkeypatch):
    whole = fitted(rows)
    expected = {r.subid: r.probability[1] for r in whole.transform(rows).collect()}
    monkeypatch.setattr(forest, "CELL_ROWS", 60)
    monkeypatch.setattr(forest, "COUNT_BYTES", 1000)
    monkeypatch.setattr(forest, "PART_ROWS", 70)
    cut = fitted(rows)
    assert whole.cells.count() == 4 and cut.cells.count() > 20
    assert all(len(t.rows) > 1 for t in cut.tops)
    got = {r.subid: r.probability[1] for r in cut.transform(rows).collect()}
    # All features are looked at, so no draw depends on the cells.
    assert got == pytest.approx(expected)
    assert list(cut.featureImportances) == pytest.approx(list(whole.featureImportances))
    assert cut.depths == whole.depths


def test_no_cell_holds_more_than_its_bound(rows, monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 60)
    model = fitted(rows, maxDepth=30, featureSubsetStrategy="2")
    for top in model.tops:
        held = top.rows[top.rows["feature"] == forest.OPEN]
        assert (held["n0"] + held["n1"] <= 60).all()
        assert (top.rows["feature"] != LEAF).any()


def test_more_rows_bring_no_more_nodes_to_the_driver(rows):
    def held(model):
        cells = sum(len(c["nodes"]) for c in model.cells.select("nodes").collect())
        return sum(len(top.rows) for top in model.tops), cells

    settings = {"maxDepth": 30, "featureSubsetStrategy": "2"}
    few, many = held(fitted(rows.where("subid < 100"), **settings)), held(fitted(rows, **settings))
    assert many[1] > 2 * few[1]
    assert few[0] == many[0] == 4


def test_a_shallow_forest_is_the_beginning_of_a_deep_one(rows):
    few, many = fitted(rows, numTrees=2, maxDepth=30), fitted(rows, numTrees=4, maxDepth=30)
    assert few.depths == many.depths[:2]
    assert max(fitted(rows, maxDepth=3).depths) == 3


def test_rare_values_odd_rows_and_one_class(spark, rows):
    # A value that one row in fifty has lies between no quantiles.
    cuts = forest.feature_cuts(rows.selectExpr("transform(array(0, 0), (v, i) -> IF(subid % 50 = 0 AND i = 1, 1D, 0D)) AS x"), 2)
    assert [list(c) for c in cuts] == [[], [0.5]]
    odd = rows.select("subid", "churn", "features").where("subid < 40")
    repeated = odd.unionByName(odd).unionByName(odd.selectExpr("CAST(NULL AS long) subid", "churn", "features"))
    model = models.fit_forest(repeated, trees=3)
    scored = models.score(repeated, model).collect()
    assert len(scored) == 120 and sum(r.subid is None for r in scored) == 40
    assert all(0 <= r.prob <= 1 and r.prediction == (r.prob > 0.5) for r in scored)
    calm = fitted(rows.where("churn = 0"))
    assert {r.probability[1] for r in calm.transform(rows).collect()} == {0.0} and calm.depths == [0] * 4
    assert models.score(rows.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        fitted(rows.limit(0))


def test_forests_of_several_depths_are_grown_once(rows, monkeypatch):
    grown = []
    plain = forest._grown_cells
    monkeypatch.setattr(forest, "_grown_cells", lambda *a: grown.append(1) or plain(*a))
    for cell in (60, 1 << 15):
        monkeypatch.setattr(forest, "CELL_ROWS", cell)
        del grown[:]
        settings = {"labelCol": "churn", "numTrees": 4, "featureSubsetStrategy": "2"}
        shared = CellForest(**settings).fit_depths(rows, [8, 1, 3])
        assert len(grown) == 1 and sorted(shared) == [1, 3, 8]
        for depth, model in shared.items():
            own = CellForest(maxDepth=depth, **settings).fit(rows)
            assert model.depths == own.depths and model.featureImportances == own.featureImportances
            expected = {r.subid: r.probability[1] for r in own.transform(rows).collect()}
            assert {r.subid: r.probability[1] for r in model.transform(rows).collect()} == expected


def test_only_crowded_cells_are_copied(spark, monkeypatch):
    """A cell is copied by its own rows, not by all rows there are."""
    monkeypatch.setattr(forest, "PART_ROWS", 10)
    routed = spark.createDataFrame([(b, 0, c, bytes(4 * n)) for b in range(8) for c, n in ((1, 1), (2, 6))], "block long, tree int, cell int, rows binary")
    cells = spark.createDataFrame([(0, 1, b"a"), (0, 2, b"b"), (1, 1, b"c")], "tree int, cell int, nodes binary")
    dealt, copied = forest._dealt(routed, cells, 56)
    found = {(r.tree, r.cell, r.part): bytes(r.nodes) for r in copied.collect()}
    assert found == {(0, 1, 0): b"a", **{(0, 2, p): b"b" for p in range(5)}, (1, 1, 0): b"c"}
    assert dealt.count() == 16 and {(r.tree, r.cell, r.part) for r in dealt.collect()} <= set(found)
