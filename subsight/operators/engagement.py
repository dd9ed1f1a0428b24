"""Trial engagement per subscriber, and its merge with the subscriber table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.constants import ACTIVITY_COUNTERS, NUMERIC_FEATURES, PER_ACTIVE_DAY
from subsight.functions.joins import split_join


def trial_engagement(engagement: DataFrame) -> DataFrame:
    """Engagement during the trial."""
    return engagement.where(F.col("payment_period") == 0)


def engagement_scope(engagement: DataFrame) -> DataFrame:
    """Distinct users with any engagement and with trial engagement."""
    per_user = engagement.groupBy("subid").agg(F.max(F.col("payment_period") == 0).alias("in_trial"))
    known = F.col("subid").isNotNull()
    return per_user.agg(
        F.count_if(known).alias("users"), F.count_if(known & F.col("in_trial")).alias("trial_users")
    )


def engagement_totals(engagement: DataFrame) -> DataFrame:
    """Sum and mean of each trial counter, and the active days, per subscriber."""
    return (
        trial_engagement(engagement)
        .groupBy("subid")
        .agg(
            *[F.sum(c).alias(f"sum_{c}") for c in ACTIVITY_COUNTERS],
            F.count_distinct("date").alias("active_days"),
            F.max("date").alias("max_day"),
            F.min("date").alias("min_day"),
            *[F.avg(c).alias(f"avg_{c}") for c in ACTIVITY_COUNTERS],
        )
    )


def with_ratios(totals: DataFrame) -> DataFrame:
    """Add the trial duration in days and the counters per day."""
    timed = totals.withColumn("duration", F.datediff("max_day", "min_day") + 1)
    ratios = {
        f"{c}_per_duration": F.try_divide(
            f"sum_{c}", "active_days" if c in PER_ACTIVE_DAY else "duration"
        )
        for c in ACTIVITY_COUNTERS
    }
    return timed.withColumns({"active_per_dur": F.try_divide("active_days", "duration"), **ratios})


def engagement_features(engagement: DataFrame) -> DataFrame:
    """The features a churn model may use, one row per subscriber."""
    return with_ratios(engagement_totals(engagement)).select(
        "subid", "active_days", "duration", "max_day", "min_day", *NUMERIC_FEATURES
    )


def engaged_only(df: DataFrame, engagement: DataFrame) -> DataFrame:
    """Rows of subscribers with any engagement, in the trial or after it."""
    return df.join(engagement.select("subid").distinct(), "subid", "left_semi")


def merge_features(subscribers: DataFrame, features: DataFrame) -> DataFrame:
    """Subscribers with their features; both sides have one row per subscriber."""
    return subscribers.join(features, "subid")


def validation_join(
    customer: DataFrame, subscribers: DataFrame, spread_by: str = "num_trial_days", hot: list | None = None
) -> DataFrame:
    """Trial outcome in the customer table beside the subscriber's own; repeats per period.

    ``spread_by`` is a customer column that varies within a subscriber, to split
    those with very many rows. ``hot`` may list those where they are known.
    """
    outcome = ["subid", "trial_completed_TF", "num_trial_days"]
    cancelled = subscribers.select("subid", "cancel_before_trial_end")
    left = customer.select(*outcome, F.col(spread_by).alias("_spread"))
    return split_join(left, cancelled, "subid", "_spread", hot=hot).select(*outcome, "cancel_before_trial_end")


def validation_counts(counted: DataFrame, subscribers: DataFrame, *cols: str) -> DataFrame:
    """Frequency table over the validation join, from customer rows counted up front.

    ``counted`` has one row per subscriber and outcome with its number of rows
    ``n``, so a subscriber with very many rows is small before the join.
    """
    joined = counted.join(subscribers.select("subid", "cancel_before_trial_end"), "subid")
    return joined.dropna(subset=list(cols)).groupBy(*cols).agg(F.sum("n").alias("n"))


def activity_after_trial(merged: DataFrame) -> DataFrame:
    """Subscribers active after their trial ended; there should be none."""
    return merged.where(F.col("max_day") > F.col("trial_end_date"))


def churn_of_row() -> Column:
    """1 unless the subscriber paid and is known not to have asked for a refund."""
    kept = F.col("paid_TF") & ~F.col("refund_after_trial_TF")
    return F.when(kept, 0).otherwise(1).cast("int")


def churn_label(df: DataFrame) -> DataFrame:
    """Add the ``churn`` label."""
    return df.withColumn("churn", churn_of_row())


def revenue_audit(merged: DataFrame) -> DataFrame:
    """Net revenue of payers, with and without refund: NULL, not above 0, above 0.

    Groups by subscriber first, for the same reason as ``scope_counts``.
    """
    revenue = F.col("revenue_net")
    per_user = (
        merged.where(F.col("paid_TF") & F.col("refund_after_trial_TF").isNotNull())
        .groupBy("refund_after_trial_TF", "subid")
        .agg(
            F.count_if(revenue.isNull()).alias("nulls"),
            F.max(revenue <= 0).alias("has_loss"),
            F.max(revenue > 0).alias("has_gain"),
        )
    )
    known = F.col("subid").isNotNull()
    return per_user.groupBy("refund_after_trial_TF").agg(
        F.sum("nulls").alias("null_revenue_rows"),
        F.count_if(known & F.col("has_loss")).alias("non_positive_users"),
        F.count_if(known & F.col("has_gain")).alias("positive_users"),
    )
