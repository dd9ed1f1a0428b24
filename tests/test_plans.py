"""Plans that must hold at scale: no cross joins, no raw rows gathered in one task."""

import re

import pytest
from pyspark.sql import functions as F

from subsight.plans import churn_value
from subsight.plans.acquisition_cost import acquisition_cost
from subsight.plans.catalog import QUERIES
from subsight.sources.star import StarInputs

LAZY = [
    "ab_conversion",
    "ab_sample_size",
    "acquisition_by_tier_channel",
    "auc",
    "binary_metrics",
    "cac_by_tier_channel",
    "churn_by_channel",
    "clv_per_subscriber",
    "cohort_counts",
    "cohort_retention",
    "confusion_matrix",
    "engagement_features",
    "refund_revenue_audit",
    "roc_curve",
    "sample_n",
    "scope_counts",
    "signups_by_tier",
    "sprt_decision",
    "tier_assign_range_join",
    "trial_days",
    "variant_profile",
    "ztest_trials",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_retention_cuts_rows_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["cohort_retention"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_only_needed_columns_are_scanned(spark, sf_dir):
    plan = plan_of(QUERIES["ab_conversion"](spark, sf_dir))
    assert "c_mktsegment" not in plan


def test_cost_counts_subscribers_in_one_pass_per_use(spark, sf_dir):
    t = StarInputs(spark, sf_dir)
    cost = acquisition_cost(t.customer_accounts, t.subscribers, t.spend)
    assert cost.cost.count() == cost.cost_paid.count() == 9 * 8
    assert plan_of(cost.acquired).count("FileScan") == 1


def test_one_subscriber_with_a_third_of_all_rows(spark):
    """A very large subscriber gives the same features as a plain aggregate."""
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 14).cast("int"))
    counters = [
        "app_opens",
        "cust_service_mssgs",
        "num_videos_completed",
        "num_videos_more_than_30_seconds",
        "num_videos_rated",
        "num_series_started",
    ]
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40 + 2).alias("subid"),
        days.alias("date"),
        F.lit(0).alias("payment_period"),
        *[F.lit(1).cast("long").alias(c) for c in counters],
    )
    subs = df.select("subid").distinct().select(
        "subid", F.lit(True).alias("paid_TF"), F.lit(False).alias("refund_after_trial_TF")
    )
    merged = churn_value.merged(subs, df)
    assert merged.count() == 41
    big = merged.where("subid = 1").first()
    assert big.active_days == 14 and big.app_opens_per_duration == pytest.approx(3000 / 14)


def test_queries_without_the_package_for_training_data(monkeypatch):
    """The entry point leaves out that package's queries and the pipeline when the package is not there."""
    import importlib.util

    import __spark_entry__ as entry_module

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "subsight.llm" else found(name, *a))
    assert set(entry_module.queries()) == set(QUERIES)
    assert "pipeline" not in entry_module.oracle_sql()
