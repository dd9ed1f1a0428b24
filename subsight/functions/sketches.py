"""Approximate counts and percentiles from sketches that are kept and merged."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two.
LG_K = 12
#: Size of a percentile sketch; its ranks are off by about 1.33 % at 200 and by less as it grows.
K = 400
RANK_ERROR = 0.01


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error of a distinct count that is passed in about 1 of 400 cases: three standard errors."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def distinct_sketches(df: DataFrame, keys: list[str], col: str, lg_k: int = LG_K) -> DataFrame:
    """One HyperLogLog sketch of ``col`` per group: a few kilobytes to write and merge later."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, lg_k).alias("sketch"))


def approx_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of each coarser group from the sketches of its parts; no key gives one row."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, F.hll_sketch_estimate("sketch").alias("approx_distinct"))


def percentile_sketches(df: DataFrame, keys: list[str], col: str, k: int = K) -> DataFrame:
    """One KLL sketch of ``col`` per group; NULL is left out, and groups of NULL only."""
    known = df.where(F.col(col).isNotNull())
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("sketch"))


def approx_percentiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Percentiles of each coarser group, one row per share, from the sketches of its parts."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    each = [
        F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("approx_value"))
        for s in shares
    ]
    return merged.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(F.array(*each)).alias("_at")).select(
        *keys, "_at.share", "n", "_at.approx_value"
    )


def rank_holds(below: Column, upto: Column, n: Column, share: Column, error: float = RANK_ERROR) -> Column:
    """Whether a value with ``below`` smaller and ``upto`` not larger rows is within ``error`` of its rank."""
    return (below <= (share + error) * n) & (upto >= (share - error) * n)
