import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subsight.functions import hashing, joins, ordered, sizes, tiers


def test_tier_bounds_are_inclusive_at_midnight(spark):
    days = [
        (dt.datetime(2018, 1, 1), 0),
        (dt.datetime(2019, 7, 30), 0),
        (dt.datetime(2019, 7, 30, 0, 0, 1), 1),
        (dt.datetime(2020, 2, 29), 7),
        (dt.datetime(2020, 2, 29, 12), 8),
        (dt.datetime(2020, 3, 30), 8),
        (dt.datetime(2020, 3, 30, 0, 0, 1), None),
        (dt.datetime(2021, 1, 1), None),
        (None, None),
    ]
    df = spark.createDataFrame(days, "account_creation_date timestamp, expected int")
    for tiered in (
        tiers.assign_tier(df),
        tiers.assign_tier_from_table(df, tiers.tier_bounds(spark)),
    ):
        for row in tiered.collect():
            assert row["tier"] == row["expected"], row


def test_tier_lookup_moves_no_rows(spark):
    df = spark.range(10).select(F.lit("2019-08-01").cast("timestamp").alias("account_creation_date"))
    plan = tiers.assign_tier(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hash_uniform_is_repeatable_and_spread(spark):
    df = spark.range(5000).select(hashing.hash_uniform("id", "x", 7).alias("u"))
    values = [r.u for r in df.collect()]
    assert values == [r.u for r in df.repartition(3).sortWithinPartitions("u").collect()] or sorted(
        values
    ) == sorted(r.u for r in df.collect())
    assert 0 <= min(values) and max(values) < 1
    assert abs(statistics.fmean(values) - 0.5) < 0.02


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_running_totals_match_a_plain_loop(spark, descending, ranges):
    rng = random.Random(3)
    # Most values crowd into a small stretch of the range.
    values = {rng.random() * 1e-6 for _ in range(400)} | {rng.random() * 100 for _ in range(50)} | {-5.0}
    rows = [(v, rng.randrange(10), rng.randrange(10)) for v in values]
    df = spark.createDataFrame(rows, "v double, a long, b long").repartition(7)
    cuts = ordered.range_cuts(df, "v", ranges)
    assert len(cuts) < ranges
    got = ordered.running_totals(df, "v", {"ra": "a", "rb": "b"}, cuts, descending)
    expected, a, b = {}, 0, 0
    for v, x, y in sorted(rows, reverse=descending):
        a, b = a + x, b + y
        expected[v] = (a, b)
    assert {r.v: (r.ra, r.rb) for r in got.collect()} == expected


def test_ranges_are_even_when_values_crowd(spark):
    df = spark.range(20000).select(F.pow(F.rand(5), 8).alias("v"))
    ranged = ordered._add_range(df, "v", ordered.range_cuts(df, "v", 32)).groupBy("_range").count()
    assert max(r["count"] for r in ranged.collect()) < 3 * 20000 / 32


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50).map(lambda x: round(x, 1))), max_size=30))
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = spark.range(1).select(ordered.exact_median(df, "v").alias("m")).first().m
    known = [v for v in values if v is not None]
    assert got == (pytest.approx(statistics.median(known)) if known else None)


def test_ranked_sample_is_the_start_of_the_hash_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(5)
    got = {r.k: r.sample_rank for r in ordered.ranked_sample(df, 700, "k", 1).collect()}
    order = [r.k for r in df.orderBy(hashing.hash_text("k", 1), "k").limit(700).collect()]
    assert got == {k: i for i, k in enumerate(order, start=1)}


def test_ranked_sample_by_group_and_past_the_end(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    counts = ordered.ranked_sample(df, 30, "k", 1, by=("g",)).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in counts} == {0: 30, 1: 30}
    assert ordered.ranked_sample(df, 1000, "k", 1).count() == 100


def test_group_positions_with_one_very_large_group(spark):
    rng = random.Random(5)
    rows = [(1 if i % 3 == 0 else rng.randrange(50), rng.randrange(20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, day int, k long").repartition(6)
    got = {r.k: r.position for r in ordered.group_positions(df, "g", "day", "k").collect()}
    seen, expected = {}, {}
    for g, _, k in sorted(rows):
        expected[k] = seen.get(g, 0)
        seen[g] = expected[k] + 1
    assert got == expected


def test_small_side_is_broadcast_only_when_it_is_small(spark):
    df = spark.range(50)
    assert sizes.small_side(df, 10) is df
    joined = spark.range(5).join(sizes.small_side(df, 50), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_a_plain_join(spark, how):
    rng = random.Random(9)
    rows = [(7 if i % 3 == 0 else rng.randrange(200), i) for i in range(3000)] + [(None, 5000), (900, 5001)]
    large = spark.createDataFrame(rows, "k long, row long").repartition(6)
    lookup = spark.createDataFrame([(k, k * 2) for k in range(300)], "k long, v long")
    assert [r.k for r in joins.hot_keys(large, "k", share=100).collect()] == [7]
    got = joins.split_join(large, lookup, "k", "row", how, salts=8)
    plain = large.join(lookup, "k", how)
    assert got.columns == plain.columns
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_sample_of_many_more_rows_than_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HASH_DIGITS", 1)
    df = spark.range(20_000).withColumn("g", F.col("id") % 2)
    hashed = df.withColumn("h", ordered.hash_text("id", 1, F.col("g")))
    for n in (5, 900):
        got = {(r.g, r.sample_rank): r.id for r in ordered.ranked_sample(df, n, "id", 1, by=("g",)).collect()}
        rows = hashed.orderBy("h", "id").collect()
        want = {(g, i + 1): r.id for g in (0, 1) for i, r in enumerate([r for r in rows if r.g == g][:n])}
        assert got == want


def test_join_with_listed_hot_keys(spark):
    large = spark.createDataFrame([(i % 5 if i % 3 else 7, i) for i in range(300)], "k long, x long")
    lookup = spark.createDataFrame([(i, i * 10) for i in range(9)], "k long, y long")
    want = sorted(map(tuple, large.join(lookup, "k").collect()))
    for hot in ([], [7], [7, 1]):
        assert sorted(map(tuple, joins.split_join(large, lookup, "k", "x", hot=hot).collect())) == want


def test_hot_share_rises_with_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50000")
        assert joins.hot_share(spark) == 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert joins.hot_share(spark) == joins.HOT_SHARE
