"""Retention cohorts: how many of each sign-up tier are still there, period by period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subsight.constants import LAST_COHORT_PERIOD
from subsight.functions.tiers import assign_tier
from subsight.operators.counts import long_to_wide


def cohort_counts(customer: DataFrame) -> DataFrame:
    """Rows alive per tier and payment period, in long form."""
    return (
        assign_tier(customer)
        .dropna(subset=["tier", "payment_period"])
        .groupBy("tier", "payment_period")
        .agg(F.count("*").alias("n_alive"))
    )


def cohort_retention(customer: DataFrame, last_period: int = LAST_COHORT_PERIOD) -> DataFrame:
    """Rows alive as a percentage of the tier's period 0, unrounded and to one place."""
    counts = cohort_counts(customer.where(F.col("payment_period").between(0, last_period)))
    start = F.max(F.when(F.col("payment_period") == 0, F.col("n_alive"))).over(W.partitionBy("tier"))
    return counts.withColumn("retention", F.try_divide(F.col("n_alive"), start) * 100).withColumn(
        "retention_1dp", F.bround("retention", 1)
    )


def cohort_retention_wide(retention: DataFrame, last_period: int = LAST_COHORT_PERIOD) -> DataFrame:
    """One row per tier, one column per period."""
    periods = list(range(last_period + 1))
    wide = long_to_wide(retention, "tier", "payment_period", periods, "retention_1dp")
    return wide.select("tier", *[F.col(str(p)).alias(f"period_{p}") for p in periods])


def cohort_counts_wide(counts: DataFrame) -> DataFrame:
    """One row per tier, one column for each period that occurs.

    The columns depend on the data, so the periods come to the driver, as the
    names they become.
    """
    periods = sorted(r[0] for r in counts.select("payment_period").distinct().collect())
    wide = long_to_wide(counts, "tier", "payment_period", periods, "n_alive")
    return wide.select("tier", *[F.col(str(p)).alias(f"period_{p}") for p in periods])
