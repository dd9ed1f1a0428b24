"""Sign-up tiers: which date band an account falls into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.constants import TIER_UPPER_BOUNDS
from subsight.functions.intervals import assign_interval


def tier_of(date_col: str, bounds: list[str] = TIER_UPPER_BOUNDS) -> Column:
    """Tier number of a date: the first band whose upper bound it does not pass.

    Tier 0 has no lower bound. NULL and dates past the last band get NULL.
    """
    branches = [
        f"when {date_col} <= timestamp '{bound} 00:00:00' then {number}"
        for number, bound in enumerate(bounds)
    ]
    return F.expr(f"case {' '.join(branches)} end")


def assign_tier(df: DataFrame, date_col: str = "account_creation_date") -> DataFrame:
    """Add ``tier`` as one expression on the row; no join and no shuffle."""
    return df.withColumn("tier", tier_of(date_col))


def tier_list(spark: SparkSession) -> DataFrame:
    """The tier numbers 0..8, for results that must show empty tiers."""
    return spark.range(len(TIER_UPPER_BOUNDS)).select(F.col("id").cast("int").alias("tier"))


def tier_bounds(spark: SparkSession, bounds: list[str] = TIER_UPPER_BOUNDS) -> DataFrame:
    """The bands as a table ``(tier, lo, hi)``; ``lo`` of tier 0 is NULL."""
    rows = list(zip(range(len(bounds)), [None, *bounds[:-1]], bounds))
    table = spark.createDataFrame(rows, "tier int, lo string, hi string")
    return table.withColumns({c: F.col(c).cast("timestamp") for c in ("lo", "hi")})


def assign_tier_from_table(
    df: DataFrame, bounds: DataFrame, date_col: str = "account_creation_date"
) -> DataFrame:
    """Add ``tier`` from a table of bands, for bands that are data, not code.

    Each row takes the band with the smallest upper bound it does not pass.
    """
    return assign_interval(df, bounds, date_col, "lo", "hi", "tier")
