"""Lifetime value per subscriber: expected payments until churn, less acquisition cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.constants import (
    CHANNEL_GROUPS,
    DISCOUNT_RATE,
    ORGANIC_CHANNELS,
    PAID_CHANNELS,
    STAND_IN_CHANNELS,
)
from subsight.functions.ordered import exact_median
from subsight.operators.counts import value_counts


def fold_channel(df: DataFrame, channel: str = "attribution_technical") -> DataFrame:
    """Add ``cac_channel``: the paid channel whose cost a row carries, or ``organic``.

    Channels on no list get NULL. The lists are constants, so this is an
    expression on the row.
    """
    name = F.col(channel)
    folded = F.when(name.isin(PAID_CHANNELS), name).when(name.isin(ORGANIC_CHANNELS), "organic")
    for stand_in, covered in STAND_IN_CHANNELS.items():
        folded = folded.when(name.isin(covered), stand_in)
    return df.withColumn("cac_channel", folded)


def assign_cac(df: DataFrame, tier_costs: DataFrame) -> DataFrame:
    """Add ``CAC_i`` by tier and folded channel; organic is 0 even without a tier."""
    # Nine tiers times eight channels: 72 rows.
    costs = tier_costs.select("tier", F.col("channel").alias("cac_channel"), F.col("cost").alias("_cost"))
    return (
        fold_channel(df)
        .join(F.broadcast(costs), ["tier", "cac_channel"], "left")
        .withColumn("CAC_i", F.when(F.col("cac_channel") == "organic", 0e0).otherwise(F.col("_cost")))
        .drop("_cost")
    )


def attach_probability(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``prob_churn`` by subscriber; a row without a score gets NULL."""
    return df.join(scores.select("subid", F.col("prob").alias("prob_churn")), "subid", "left")


def mean_payment(df: DataFrame, price: str = "discount_price") -> Column:
    """Mean price over all rows as a scalar subquery.

    Summed as decimals: unlike doubles, they give the same sum in any order,
    so every value that builds on it comes out the same when run again.
    """
    total = F.sum(F.col(price).cast("decimal(28,10)")).cast("double")
    return df.agg(F.try_divide(total, F.count(price)).alias("payment")).scalar()


def clv(df: DataFrame, payment: Column, discount: float = DISCOUNT_RATE) -> DataFrame:
    """Add ``CLV_i`` = payment (1 + d) / ((1 + d) - 1 + churn probability) - cost."""
    growth = 1 + discount
    expected = F.try_divide(payment * growth, F.lit(growth - 1) + F.col("prob_churn"))
    return df.withColumn("CLV_i", expected - F.col("CAC_i"))


def clv_summary(df: DataFrame, col: str = "CLV_i") -> DataFrame:
    """Mean, exact median, smallest and largest value."""
    return df.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ).withColumn("median", exact_median(df, col))


def cac_null_channels(df: DataFrame) -> DataFrame:
    """Channels of the rows without a cost; only channels on no list should be here."""
    return value_counts(df.where(F.col("CAC_i").isNull()), "attribution_technical")


def cac_audit(df: DataFrame) -> DataFrame:
    """Tier, channel and cost side by side."""
    return df.select("subid", "tier", "attribution_technical", "CAC_i")


def churn_by_channel(df: DataFrame, channels: list[str] = PAID_CHANNELS) -> DataFrame:
    """Churn rate of each channel, lowest first."""
    return (
        df.where(F.col("attribution_technical").isin(channels))
        .groupBy(F.col("attribution_technical").alias("channel"))
        .agg(F.sum("churn").alias("churned"), F.count("*").alias("n_rows"))
        .withColumn("churn_rate", F.col("churned") / F.col("n_rows"))
        .orderBy("churn_rate", "channel")
    )


def churn_by_channel_group(
    df: DataFrame, groups: dict[str, list[str]] = CHANNEL_GROUPS
) -> DataFrame:
    """Pooled churn rate of groups of channels."""
    group = F.lit(None).cast("string")
    for name, channels in groups.items():
        group = F.when(F.col("attribution_technical").isin(channels), name).otherwise(group)
    return (
        df.withColumn("channel_group", group)
        .where(F.col("channel_group").isNotNull())
        .groupBy("channel_group")
        .agg(F.sum("churn").alias("churned"), F.count("*").alias("n_rows"))
        .withColumn("churn_rate", F.col("churned") / F.col("n_rows"))
    )
