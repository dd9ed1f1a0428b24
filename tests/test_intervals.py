"""Interval lookup, exact splits, even folds, neighbours and sketches against plain Python."""

import bisect
import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsight.functions import intervals, sketches
from subsight.functions.ordered import range_cuts, with_next
from subsight.operators import distribution, metrics, prep

BANDS = "band long, lo double, hi double"


def first_band(bands, x):
    if x is None:
        return None
    held = [
        (hi is None, hi if hi is not None else 0, band)
        for band, lo, hi in bands
        if (lo is None or x > lo) and (hi is None or x <= hi) and (lo is None or hi is None or lo < hi)
    ]
    return min(held)[2] if held else None


@pytest.mark.parametrize("case", ["nested", "disjoint", "same_low", "few", "none", "open"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_overlapping_bands_against_all_bands(spark, monkeypatch, case, broadcast):
    rng = random.Random(case)
    if not broadcast:
        monkeypatch.setattr(intervals, "MAX_BROADCAST_BANDS", 0)
    bands = {
        "nested": [(i, float(rng.randrange(500)), float(rng.randrange(500))) for i in range(700)],
        "disjoint": [(i, i * 2.0, i * 2.0 + 1.5) for i in range(600)],
        "same_low": [(i, 10.0, 10.0 + rng.randrange(300)) for i in range(500)],
        "few": [(1, 1.0, 2.0), (2, 2.0, 3.0)],
        "none": [],
        "open": [(i, None if i % 3 == 0 else rng.random() * 100, None if i % 5 == 0 else rng.random() * 100) for i in range(300)],
    }[case]
    values = [None, -1e9, 1e9, 0.0, 10.0, 2.0, float("inf")] + [rng.random() * 1300 for _ in range(300)]
    values += [b[1] for b in bands[:50]] + [b[2] for b in bands[:50]] + [77.0] * 300
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    found = intervals.assign_interval(df, spark.createDataFrame(bands, BANDS), "v")
    assert found.columns == ["k", "v", "band"]
    assert {r.k: r.band for r in found.collect()} == {k: first_band(bands, v) for k, v in enumerate(values)}


def test_a_hundred_thousand_bands(spark):
    bands = spark.range(100_000).select(
        F.col("id").alias("band"), (F.col("id") * 3).cast("double").alias("lo"), (F.col("id") * 3 + 2).cast("double").alias("hi")
    )
    df = spark.range(200_000).select((F.col("id") * 7 % 299_999 + 0.5).alias("v"))
    wrong = intervals.assign_interval(df, bands, "v").where(
        ~F.equal_null("band", F.when(F.expr("v % 3") < 2, F.floor(F.expr("v / 3"))))
    )
    assert wrong.count() == 0
    index, cuts, number = intervals.interval_index(bands, "lo", "hi", "band")
    assert number == 100_000 and len(cuts) < intervals.MAX_CELLS
    assert index.agg(F.max(F.size("candidates"))).first()[0] < 100


def test_bands_of_time(spark):
    day = datetime.datetime(2020, 1, 1)
    bands = [(i, day + datetime.timedelta(days=i), day + datetime.timedelta(days=i + 1)) for i in range(40)]
    df = spark.createDataFrame([(day + datetime.timedelta(hours=h),) for h in range(0, 1000, 7)], "t timestamp")
    found = intervals.assign_interval(df, spark.createDataFrame(bands, "band int, lo timestamp, hi timestamp"), "t")
    for r in found.collect():
        after = [b for b, lo, hi in bands if lo < r.t <= hi]
        assert r.band == (after[0] if after else None)


@pytest.mark.parametrize("rows", [0, 1, 2, 7, 1001])
@pytest.mark.parametrize("cell", [10_000, 3])
def test_exact_split(spark, monkeypatch, rows, cell):
    monkeypatch.setattr(prep, "MAX_CELL", cell)
    monkeypatch.setattr(prep, "PREFIX", 1)
    df = spark.range(rows).withColumnRenamed("id", "subid")
    train, test = prep.exact_split(df)
    assert test.count() == math.ceil(0.4 * rows) and train.count() == rows - math.ceil(0.4 * rows)
    assert train.join(test, "subid").count() == 0
    smaller = {r.subid for r in prep.exact_split(df, 0.1)[1].collect()}
    assert smaller <= {r.subid for r in test.collect()}
    assert prep.exact_split(df, 0.0)[1].count() == 0 and prep.exact_split(df, 1.0)[0].count() == 0


def test_folds_are_even_in_each_class(spark):
    rows = [(i, None if i % 50 == 0 else int(i % 7 == 0), i % 2 == 0) for i in range(1234)]
    df = spark.createDataFrame(rows, "subid long, churn int, is_test boolean")
    found = prep.stratified_folds(df, within=("is_test",)).collect()
    assert len(found) == len(rows)
    held = Counter((r.is_test, r.churn, r.fold) for r in found)
    for group in {(t, c) for t, c, _ in held}:
        counts = [held[(*group, f)] for f in range(5)]
        assert max(counts) - min(counts) <= 1
    again = {r.subid: r.fold for r in prep.stratified_folds(df.repartition(7), within=("is_test",)).collect()}
    assert again == {r.subid: r.fold for r in found}


@pytest.mark.parametrize("descending", [False, True])
def test_next_rows_across_ranges(spark, descending):
    values = random.Random(2).sample(range(10_000), 300)
    df = spark.createDataFrame([(float(v), v * 2) for v in values], "x double, y long")
    found = with_next(df, "x", {"after": "y"}, range_cuts(df, "x", 9), descending).collect()
    ordered = sorted(values, reverse=descending)
    assert {r.x: r.after for r in found} == {float(v): n for v, n in zip(ordered, [*[v * 2 for v in ordered[1:]], None])}


def test_roc_without_points_on_a_line(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(40) / 40) for _ in range(60)] + [(1, i / 500 + 2) for i in range(30)]
    df = spark.createDataFrame(rows, "churn int, prob double")
    everything = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc(df).collect()}
    kept = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc(df, drop_intermediate=True).collect()}
    scores = sorted({p for _, p in rows}, reverse=True)
    steps = [Counter(c for c, p in rows if p == s) for s in scores]
    corners = [s for i, s in enumerate(scores) if i in (0, len(scores) - 1) or steps[i] != steps[i + 1]]
    assert set(kept) == {None, *corners} and len(kept) < len(everything) - 20
    assert all(everything[t] == point for t, point in kept.items())


def test_binned_curve_is_near_the_exact_one(spark):
    rng = np.random.default_rng(5)
    values = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", float(v)) for v in rng.gamma(2, 10, size=500)]
    values += [("a", 30.0), ("c", 1.0), ("c", 1.0), ("b", None), (None, 1.0)]
    df = spark.createDataFrame(values, "g string, v double")
    exact = {(r.g, r.point): r for r in distribution.kde_by(df, "g", "v").collect()}
    for r in distribution.kde_binned(df, "v", "g").collect():
        other = exact.pop((r.g, r.point))
        assert r.x == pytest.approx(other.x, abs=1e-9)
        assert r.density == pytest.approx(other.density, abs=1e-4)
    assert not exact
    plain = {r.point: r.density for r in distribution.kde(df, "v").collect()}
    assert {r.point: pytest.approx(r.density, abs=1e-4) for r in distribution.kde_binned(df, "v").collect()} == plain


def test_sketches_merge_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 60_000).alias("x"), (F.col("id") % 7).alias("part"), F.rand(1).alias("v"))
    parts = sketches.distinct_sketches(df, ["part"], "x")
    assert abs(sketches.approx_distinct(parts, []).first()["approx_distinct"] / 60_000 - 1) < sketches.distinct_error()
    values = sorted(r.v for r in df.select("v").collect())
    held = sketches.percentile_sketches(df, ["part"], "v")
    for r in sketches.approx_percentiles(held, [], [0.01, 0.5, 0.99]).collect():
        place = bisect.bisect_left(values, r.approx_value) / len(values)
        assert r.n == len(values) and abs(place - r.share) <= sketches.RANK_ERROR


def test_distributions_of_many_groups_are_those_of_few(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, rng.gauss(0, 3), 1.0])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")

    def everything():
        made = [distribution.histogram_by(df, "g", "v"), distribution.kde_by(df, "g", "v"), distribution.kde_binned(df, "v", "g")]
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in m.collect()) for m in made]

    small = everything()
    monkeypatch.setattr(distribution, "small_side", lambda side: side)
    assert everything() == small and all(small)


def test_spans_shrink_to_runs_of_cells(spark):
    """However many bands span the cells, what is cut into steps grows with the cells."""
    rng = random.Random(2)
    spans = [(rank, a, a + 1 + rng.randrange(64 - a)) for rank, a in ((i, rng.randrange(64)) for i in range(5000))]
    runs = intervals._overlapping_runs(spark.createDataFrame(spans, "rank int, a int, b int")).collect()
    assert len(runs) <= 64 * 7 and {r.b - r.a for r in runs} <= {1, 2, 4, 8, 16, 32, 64}
    for cell in range(64):
        assert min(r.rank for r in runs if r.a <= cell < r.b) == min(k for k, a, b in spans if a <= cell < b)
