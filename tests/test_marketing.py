import datetime as dt

import pytest

from subsight.constants import ORGANIC_CHANNELS, PAID_CHANNELS
from subsight.operators import acquisition, clv, cohort, engagement
from subsight.plans.acquisition_cost import acquisition_cost

TIER_DAYS = [dt.datetime(2019, 7, 1), dt.datetime(2019, 8, 15), dt.datetime(2019, 9, 15)]


def subscribers(spark, rows):
    return spark.createDataFrame(
        [(i, TIER_DAYS[t] if t is not None else None, c, p) for i, (t, c, p) in enumerate(rows)],
        "subid long, account_creation_date timestamp, attribution_technical string, paid_TF boolean",
    )


def spend(spark, amount=100.0):
    rows = [(i, *[amount * (i + 1)] * len(PAID_CHANNELS)) for i in range(10)]
    return spark.createDataFrame(rows, "period_idx int, " + ", ".join(f"`{c}` double" for c in PAID_CHANNELS))


def test_cost_of_cells_and_means(spark):
    subs = subscribers(
        spark,
        [(0, "email", True), (0, "email", False), (0, "tv", True), (1, "email", False), (None, "email", True)],
    )
    customer = subs.where("subid <> 2").unionByName(subs.where("subid <> 2")).unionByName(subs)
    cost = acquisition_cost(customer, subs, spend(spark))
    signups = {r.tier: r.total_signups for r in cost.signups.collect()}
    assert len(signups) == 9 and signups[0] == 3 and signups[1] == 1 and signups[2] == 0
    share = {r.tier: r.known_share for r in cost.share.collect()}
    assert share[0] == pytest.approx(2 / 3) and share[1] == 1.0 and share[2] is None
    cells = {(r.tier, r.channel): r.cost for r in acquisition.with_means(cost.cost).collect()}
    assert len(cells) == 9 * 8 + 8
    assert cells[0, "email"] == pytest.approx(100 * 2 / 3 / 2)
    assert cells[1, "email"] == pytest.approx(200.0)
    assert cells[0, "search"] is None and cells[None, "search"] is None
    assert cells[None, "email"] == pytest.approx((100 / 3 + 200) / 2)
    paid = {(r.tier, r.channel): r.cost for r in acquisition.with_means(cost.cost_paid).collect()}
    assert paid[0, "email"] == pytest.approx(100 * 2 / 3) and paid[1, "email"] is None
    wide = {r.row_label: r for r in acquisition.cost_wide(cost.cost).collect()}
    assert len(wide) == 10 and wide["mean"]["email"] == pytest.approx((100 / 3 + 200) / 2)


def test_cost_lookup_folds_channels(spark):
    subs = subscribers(
        spark, [(0, "youtube", True), (0, "bing", True), (None, "tv", True), (0, "nowhere", True), (None, "email", True)]
    )
    costs = spark.createDataFrame(
        [(0, "facebook", 5.0), (0, "brand sem intent google", 7.0)], "tier int, channel string, cost double"
    )
    from subsight.functions.tiers import assign_tier

    got = {r.attribution_technical: r.CAC_i for r in clv.assign_cac(assign_tier(subs), costs).collect()}
    assert got == {"youtube": 5.0, "bing": 7.0, "tv": 0.0, "nowhere": None, "email": None}


def test_every_listed_channel_folds(spark):
    df = spark.createDataFrame([(c,) for c in ORGANIC_CHANNELS], "attribution_technical string")
    assert {r.cac_channel for r in clv.fold_channel(df).collect()} == {"organic"}


def test_lifetime_value_formula(spark):
    df = spark.createDataFrame(
        [(1, 4.0, 2.0, 0.5), (2, 6.0, 0.0, 0.0), (3, 5.0, 1.0, None)],
        "subid long, discount_price double, CAC_i double, prob_churn double",
    )
    got = {r.subid: r.CLV_i for r in clv.clv(df, clv.mean_payment(df)).collect()}
    assert got[1] == pytest.approx(5 * 1.1 / 0.6 - 2)
    assert got[2] == pytest.approx(5 * 1.1 / 0.1)
    assert got[3] is None
    summary = clv.clv_summary(clv.clv(df, clv.mean_payment(df))).first()
    assert summary.n == 2 and summary.median == pytest.approx((got[1] + got[2]) / 2)


def test_retention_counts_from_period_zero(spark):
    rows = [(0, p, n) for p, n in [(0, 8), (1, 3), (2, 1), (13, 2)]] + [(1, 1, 4)]
    df = spark.createDataFrame(
        [(TIER_DAYS[t], p) for t, p, n in rows for _ in range(n)],
        "account_creation_date timestamp, payment_period int",
    )
    got = {(r.tier, r.payment_period): r.retention for r in cohort.cohort_retention(df).collect()}
    assert got == {(0, 0): 100.0, (0, 1): 37.5, (0, 2): 12.5, (1, 1): None}
    one_place = {(r.tier, r.payment_period): r.retention_1dp for r in cohort.cohort_retention(df).collect()}
    assert one_place[0, 2] == 12.5
    counts = {(r.tier, r.payment_period): r.n_alive for r in cohort.cohort_counts(df).collect()}
    assert counts[0, 13] == 2


def test_one_place_rounds_half_to_even(spark):
    df = spark.createDataFrame(
        [(TIER_DAYS[0], p) for p, n in [(0, 400), (1, 1), (2, 3)] for _ in range(n)],
        "account_creation_date timestamp, payment_period int",
    )
    got = {r.payment_period: r.retention_1dp for r in cohort.cohort_retention(df).collect()}
    assert got == {0: 100.0, 1: 0.2, 2: 0.8}


def test_engagement_ratios_use_the_right_divisor(spark):
    day = dt.date(2020, 1, 1)
    rows = [
        (1, day, 0, 2, 4, 6, 8, 10, 12),
        (1, day + dt.timedelta(9), 0, 2, 4, 6, 8, 10, 12),
        (1, day + dt.timedelta(20), 1, 99, 99, 99, 99, 99, 99),
    ]
    df = spark.createDataFrame(
        rows,
        "subid long, date date, payment_period int, app_opens long, cust_service_mssgs long,"
        " num_videos_completed long, num_videos_more_than_30_seconds long, num_videos_rated long,"
        " num_series_started long",
    )
    got = engagement.engagement_features(df).first()
    assert (got.active_days, got.duration, got.active_per_dur) == (2, 10, 0.2)
    assert got.app_opens_per_duration == 4 / 2
    assert got.num_videos_more_than_30_seconds_per_duration == 16 / 2
    assert got.cust_service_mssgs_per_duration == 8 / 10
    assert got.num_series_started_per_duration == 24 / 10
    scope = engagement.engagement_scope(df).first()
    assert (scope.users, scope.trial_users) == (1, 1)


def test_churn_label_with_unknown_flags(spark):
    rows = [(True, False, 0), (True, True, 1), (True, None, 1), (False, False, 1), (None, False, 1)]
    df = spark.createDataFrame(rows, "paid_TF boolean, refund_after_trial_TF boolean, expected int")
    assert all(r.churn == r.expected for r in engagement.churn_label(df).collect())


def test_validation_counts_equal_the_join(spark):
    customer = spark.createDataFrame(
        [(1, True, 3)] * 50 + [(1, False, 3), (2, True, 0), (3, True, 1)],
        "subid long, trial_completed_TF boolean, num_trial_days int",
    )
    subs = spark.createDataFrame([(1, False), (2, True)], "subid long, cancel_before_trial_end boolean")
    counted = customer.groupBy("subid", "trial_completed_TF", "num_trial_days").count()
    got = engagement.validation_counts(
        counted.withColumnRenamed("count", "n"), subs, "trial_completed_TF", "cancel_before_trial_end"
    )
    plain = engagement.validation_join(customer, subs).groupBy("trial_completed_TF", "cancel_before_trial_end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.count().collect()))


def test_churn_by_channel_is_sorted(spark):
    df = spark.createDataFrame(
        [("email", 1), ("email", 0), ("search", 0), ("tv", 1), ("affiliate", 1)],
        "attribution_technical string, churn int",
    )
    assert [r.channel for r in clv.churn_by_channel(df).collect()] == ["search", "email", "affiliate"]
    groups = {r.channel_group: r.churn_rate for r in clv.churn_by_channel_group(df).collect()}
    assert groups == {"group_1": pytest.approx(2 / 3), "group_2": 0.0}
