import math

import pytest

from subsight.operators import abtest
from subsight.sources.tables import nan_to_null

SCHEMA = "subid long, join_fee double, paid_TF boolean"


def people(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_missing_fee_is_in_no_variant(spark):
    df = nan_to_null(people(spark, [(1, 1.0, True), (2, 0.0, True), (3, None, True), (4, math.nan, True)]))
    assert {(r.subid, r.variant) for r in abtest.variants(df).collect()} == {(1, "A"), (2, "B")}


def test_scope_counts_repeated_users_once(spark):
    df = people(spark, [(1, 1.0, True), (1, 2.0, True), (2, 0.0, True), (3, None, True), (3, None, True)])
    row = abtest.scope_counts(df).first()
    assert row.asDict() == {
        "total_users": 3,
        "null_fee_rows": 2,
        "focus_rows": 3,
        "users_a": 1,
        "users_b": 1,
        "users_in_test": 2,
    }


def test_shares_divide_by_all_rows_of_the_variant(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x"), (2, 1.0, None), (3, 1.0, "y"), (4, 1.0, "x"), (5, 0.0, "x")],
        "subid long, join_fee double, op_sys string",
    )
    got = {(r.variant, r.value): r.percent for r in abtest.variant_profile(df, ["op_sys"]).collect()}
    assert got == {("A", "x"): 50.0, ("A", "y"): 25.0, ("B", "x"): 100.0}


def test_unknown_payment_counts_in_the_divisor(spark):
    df = people(spark, [(1, 1.0, True), (2, 1.0, None), (3, 0.0, False)])
    assert {r.variant: r.rate for r in abtest.conversion(df).collect()} == {"A": 0.5, "B": 0.0}


def ab_rows(n_a, paid_a, n_b, paid_b):
    rows = [(i, 1.0, i < paid_a) for i in range(n_a)]
    return rows + [(1000 + i, 0.0, i < paid_b) for i in range(n_b)]


def test_sample_size_and_z_scores(spark):
    df = people(spark, ab_rows(100, 40, 80, 44))
    p0, p1, bar = 0.4, 0.55, 0.475
    size = (1.959963984540054 * math.sqrt(2 * bar * (1 - bar)) + 0.84162 * math.sqrt(0.24 + 0.2475)) ** 2
    assert abtest.sample_size(df).first().sample_size == pytest.approx(size / (p1 - p0) ** 2)
    assert abtest.z_one_sample(df).first().z == pytest.approx(0.15 / math.sqrt(0.24 / 80))
    pooled = 84 / 180
    assert abtest.z_two_sample(df).first().z == pytest.approx(
        0.15 / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 80))
    )


def test_no_difference_gives_no_sample_size(spark):
    df = people(spark, ab_rows(10, 5, 10, 5))
    assert abtest.sample_size(df).first().sample_size is None


def test_trials_take_exactly_n_rows_and_add_up(spark):
    trials = abtest.z_trials(people(spark, ab_rows(100, 40, 90, 60)), n=30, trials=4)
    rows = trials.collect()
    assert sorted(r.trial for r in rows) == [1, 2, 3, 4] and {r.n for r in rows} == {30}
    assert len({r.conversions for r in rows}) > 1
    decision = abtest.trial_decisions(trials).first()
    assert decision.reject_null + decision.accept_null == 4
    assert decision.reject_null == sum(r.z >= 1.96 for r in rows)


def test_sequential_test_stops_where_a_loop_would(spark):
    df = people(spark, ab_rows(100, 30, 300, 180))
    steps = [r.paid_TF for r in sorted(
        abtest.sample_n(abtest.variants(df).where("variant = 'B'"), 300).collect(), key=lambda r: r.sample_rank
    )]
    total, count = 0.0, 0
    while -1.6 < total < 2.99:
        total += math.log(0.6 / 0.3) if steps[count] else math.log(0.4 / 0.7)
        count += 1
    got = abtest.sprt(df, n=300).first()
    assert (got.step, got.decision) == (count, "reject" if total >= 2.99 else "accept")
    assert got.log_ratio == pytest.approx(total)
    trace = abtest.sprt_trace(df, n=300).collect()
    assert sorted(r.step for r in trace) == list(range(1, count + 1))


def test_sequential_test_that_never_stops_is_undecided(spark):
    got = abtest.sprt(people(spark, ab_rows(100, 50, 10, 5)), n=300).first()
    assert (got.step, got.decision) == (10, "undecided")
