"""Acquisition cost by sign-up tier and paid channel.

Results have a row per tier (nine) or per tier and paid channel (72), so they
are broadcast to each other without a further check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.constants import PAID_CHANNELS, UNUSED_SPEND_PERIOD
from subsight.functions.tiers import assign_tier, tier_list
from subsight.operators.counts import long_to_wide, wide_to_long


def signups_by_tier(customer: DataFrame) -> DataFrame:
    """Distinct subscribers per tier; a tier without any shows 0."""
    counted = (
        assign_tier(customer)
        .where(F.col("tier").isNotNull())
        .groupBy("tier")
        .agg(F.count_distinct("subid").alias("total_signups"))
    )
    return (
        tier_list(customer.sparkSession)
        .join(F.broadcast(counted), "tier", "left")
        .select("tier", F.coalesce("total_signups", F.lit(0)).alias("total_signups"))
    )


def acquisition(subscribers: DataFrame) -> DataFrame:
    """Subscribers (``n``) and payers (``n_paid``) per tier and channel, in one pass."""
    return (
        assign_tier(subscribers)
        .dropna(subset=["tier", "attribution_technical"])
        .groupBy("tier", F.col("attribution_technical").alias("channel"))
        .agg(F.count("*").alias("n"), F.count_if("paid_TF").alias("n_paid"))
    )


def paid_channels_only(acquired: DataFrame) -> DataFrame:
    """The part of the counts that advertising spend can be set against."""
    return acquired.where(F.col("channel").isin(PAID_CHANNELS))


def payers_only(acquired: DataFrame) -> DataFrame:
    """The counts of payers, under the name ``n``."""
    return acquired.where(F.col("n_paid") > 0).select("tier", "channel", F.col("n_paid").alias("n"))


def acquisition_wide(acquired: DataFrame) -> DataFrame:
    """One row per tier, one column per paid channel; no rows gives NULL."""
    return long_to_wide(acquired, "tier", "channel", PAID_CHANNELS, "n")


def known_share(acquired: DataFrame, signups: DataFrame) -> DataFrame:
    """Share of each tier's sign-ups whose paid channel is known."""
    known = (
        paid_channels_only(acquired)
        .groupBy("tier")
        .agg(F.sum("n").alias("known_signups"))
    )
    return (
        signups.join(F.broadcast(known), "tier", "left")
        .withColumn("known_signups", F.coalesce("known_signups", F.lit(0)))
        .withColumn("known_share", F.try_divide("known_signups", "total_signups"))
    )


def scaled_spend(spend: DataFrame, share: DataFrame) -> DataFrame:
    """Spend per tier and channel, cut down to the known share of sign-ups."""
    used = spend.where(F.col("period_idx") != UNUSED_SPEND_PERIOD)
    cells = wide_to_long(used, "period_idx", PAID_CHANNELS, "channel", "spend")
    return (
        cells.withColumnRenamed("period_idx", "tier")
        .join(F.broadcast(share.select("tier", "known_share")), "tier", "left")
        .select("tier", "channel", (F.col("spend") * F.col("known_share")).alias("spend"))
    )


def cost_per_person(scaled: DataFrame, acquired: DataFrame, people: str = "n") -> DataFrame:
    """Cost per acquired person for each tier and channel; a cell without people is NULL.

    ``people`` is the count to divide by: ``n`` for all, ``n_paid`` for payers.
    """
    known = F.broadcast(paid_channels_only(acquired))
    return scaled.join(known, ["tier", "channel"], "left").select(
        "tier", "channel", F.try_divide("spend", people).alias("cost")
    )


def with_means(costs: DataFrame) -> DataFrame:
    """Add the mean of each channel over its tiers, in rows with a NULL ``tier``.

    A cell is a group of one, so one aggregate gives cells and means alike.
    """
    by_cell, by_channel = ["tier", "channel"], ["channel"]
    return costs.groupingSets([by_cell, by_channel], "tier", "channel").agg(F.avg("cost").alias("cost"))


def cost_wide(costs: DataFrame) -> DataFrame:
    """Cost table as written to file: a labelled row per tier, then the mean row."""
    label = F.coalesce(F.concat(F.lit("tier"), F.col("tier")), F.lit("mean"))
    wide = (
        with_means(costs)
        .withColumn("row_label", label)
        .groupBy("row_label", "tier")
        .pivot("channel", PAID_CHANNELS)
        .agg(F.first("cost"))
    )
    return wide.select("row_label", "tier", *PAID_CHANNELS)


def cost_long(wide: DataFrame) -> DataFrame:
    """Cost per tier and channel from the written table; the mean row, without a tier, goes."""
    return wide_to_long(wide.where(F.col("tier").isNotNull()), "tier", PAID_CHANNELS, "channel", "cost")
