import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsight.functions import alias
from subsight.operators import counts, distribution, metrics, prep


def test_prune_keeps_columns_below_the_limit(spark):
    rows = [(i, None if i < 17 else i, None if i < 16 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, at_limit long, below long")
    assert prep.prune_null_columns(df).columns == ["k", "below"]


def test_imputation_fills_by_frequency_and_keeps_known_values(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(400)] + [(i, None) for i in range(400, 4400)]
    df = spark.createDataFrame(rows, "subid long, op_sys string")
    filled = {r.subid: r.op_sys for r in prep.impute_by_frequency(df, ["op_sys"]).collect()}
    assert len(filled) == 4400 and all(filled[i] == v for i, v in rows[:400])
    share = sum(filled[i] == "a" for i in range(400, 4400)) / 4000
    assert share == pytest.approx(0.75, abs=0.03)


def test_imputation_is_the_same_when_categories_are_too_many_for_the_driver(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, None if i % 3 == 0 else f"c{min(rng.randrange(300), rng.randrange(300))}", None) for i in range(1500)]
    rows += [(5000 + i, None, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "subid long, intended_use string, op_sys string")
    small = sorted(map(tuple, prep.impute_by_frequency(df).collect()))
    monkeypatch.setattr(alias, "SMALL", 5)
    assert sorted(map(tuple, prep.impute_by_frequency(df).collect())) == small
    assert len(small) == len(rows) and all(v is not None for row in small for v in row)


def weights_of(rows, size):
    """What each category gets in all: its own slot and what it fills of others."""
    got = {}
    for _, category, kept, other in rows:
        got[category] = got.get(category, 0.0) + kept
        if other is not None:
            got[other] = got.get(other, 0.0) + 1 - kept
    return {c: w / len(rows) * size for c, w in got.items()}


@pytest.mark.parametrize("case", ["even", "one", "skewed", "two", "random", "thirds"])
def test_alias_tables_hold_the_weights(spark, case):
    rng = random.Random(case)
    counts = {
        "even": [(f"c{i}", 5) for i in range(9)],
        "one": [("only", 3)],
        "two": [("a", 1), ("b", 999)],
        "skewed": [("big", 10**9)] + [(f"c{i}", 1) for i in range(200)],
        "random": [(f"c{i}", rng.randrange(1, 1000)) for i in range(300)],
        "thirds": [(f"c{i}", 3 if i % 2 else 1) for i in range(100)],
    }[case]
    size = sum(n for _, n in counts)
    rows = alias.alias_rows(counts)
    assert sorted(r[0] for r in rows) == list(range(len(counts)))
    assert weights_of(rows, size) == pytest.approx(dict(counts), rel=1e-6)
    spread = alias.alias_table(spark.createDataFrame(counts, "category string, n long"))
    assert sorted(map(tuple, spread.collect())) == sorted(rows)


def test_alias_table_of_many_categories(spark):
    counted = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("category"), (F.col("id") % 97 + 1).alias("n"))
    rows = [tuple(r) for r in alias.alias_table(counted).collect()]
    size = sum(i % 97 + 1 for i in range(200_000))
    got = weights_of(rows, size)
    assert len(got) == 200_000 and max(abs(got[f"c{i}"] - (i % 97 + 1)) for i in range(200_000)) < 1e-3


def test_one_hot_keeps_all_categories_and_null_is_all_zero(spark):
    df = spark.createDataFrame(
        [(1, "x", True), (2, "y.z", None), (3, None, False)], "subid long, plan string, male_TF boolean"
    )
    encoded, names = prep.one_hot(df, ["plan", "male_TF"])
    assert names == ["plan_x", "plan_y.z", "male_TF"]
    assert {r.subid: tuple(r)[1:] for r in encoded.collect()} == {1: (1, 0, 1), 2: (0, 1, 0), 3: (0, 0, 0)}


def test_scaling_uses_train_rows_without_clipping(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = spark.createDataFrame([(2.0, 5.0), (5.0, 9.0)], "a double, b double")
    assert [tuple(r) for r in prep.minmax(rows, train, ["a", "b"]).collect()] == [(0.5, 0.0), (2.0, 0.0)]


def test_split_is_stable_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "subid")
    train, test = prep.split(df)
    assert train.count() + test.count() == 2000
    assert test.count() == pytest.approx(800, abs=80)
    again = prep.split(df.repartition(9))[1]
    assert {r.subid for r in again.collect()} == {r.subid for r in test.collect()}
    assert df.select(prep.fold_of().alias("f")).distinct().count() == 5


def scored(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "churn int, prob double")
    return df.withColumn("prediction", (F.col("prob") > 0.5).cast("int")), rows


def test_auc_equals_all_pairs(spark):
    df, rows = scored(spark)
    pos = [p for c, p in rows if c == 1]
    neg = [p for c, p in rows if c == 0]
    pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(df).first().auc == pytest.approx(pairs)
    roc = sorted((r.fpr, r.tpr) for r in metrics.roc(df).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(pairs)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "churn int, prob double")
    assert metrics.auc(df).first().auc is None


def test_metrics_and_report_agree(spark):
    df, rows = scored(spark)
    cells = {(r.label, r.predicted): r.n for r in metrics.confusion(df).collect()}
    assert sum(cells.values()) == len(rows)
    m = metrics.binary_metrics(df).first()
    report = {r.row_label: r for r in metrics.class_report(df).collect()}
    assert report["1"].precision == pytest.approx(m.precision)
    assert report["1"].recall == pytest.approx(cells[1, 1] / (cells[1, 1] + cells[1, 0]))
    assert report["accuracy"].f1 == pytest.approx(m.accuracy)
    assert report["weighted avg"].recall == pytest.approx(m.accuracy)


def test_ratios_without_a_base_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "churn int, prediction int")
    assert tuple(metrics.binary_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("bounds", [None, (-1.0, 2.5)])
def test_histogram_equals_numpy(spark, bounds):
    rng = random.Random(4)
    values = [round(rng.gauss(0, 2), 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    low, high = bounds or (None, None)
    got = sorted(distribution.histogram(df, "v", 20, low, high).collect())
    n, edges = np.histogram(values, bins=20, range=bounds)
    assert [r.n for r in got] == list(n)
    assert [r.bin_start for r in got] == pytest.approx(list(edges[:-1]))


def test_grouped_histogram_has_area_one(spark):
    rows = [("a", float(i)) for i in range(40)] + [("b", 3.0)] * 5 + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = distribution.histogram_by(df, "g", "v", 10).collect()
    by_group = {g: [r for r in got if r.g == g] for g in ("a", "b")}
    assert len(got) == 20
    assert sum(r.density for r in by_group["a"]) * 3.9 == pytest.approx(1)
    assert sum(r.density for r in by_group["b"]) * 0.1 == pytest.approx(1)
    assert sum(r.n for r in by_group["b"]) == 5


def test_density_equals_numpy(spark):
    rng = random.Random(6)
    values = np.array([rng.gauss(1, 3) for _ in range(200)])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 25)
    dens = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    for got in (distribution.kde(df, "v", 25), distribution.kde_by(df, "g", "v", 25)):
        rows = sorted(got.collect(), key=lambda r: r.point)
        assert [r.x for r in rows] == pytest.approx(list(grid))
        assert [r.density for r in rows] == pytest.approx(list(dens))


def test_value_counts_drop_null_and_sort(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in counts.value_counts(df, "v").collect()] == [("b", 2), ("a", 1)]
    assert {tuple(r) for r in counts.null_shares(df).collect()} == {("v", 25.0)}
