"""Histograms and density curves as tables: the numbers behind the plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.constants import DENSITY_POINTS, HISTOGRAM_BINS
from subsight.functions.joins import split_join
from subsight.functions.sizes import small_side

#: Bins of a binned density curve in one bandwidth, and bandwidths beyond which a value adds nothing.
BINS_PER_BANDWIDTH = 64
REACH = 8


def _edge(low: Column, high: Column, bins: int, number: Column) -> Column:
    """Left edge of a bin; the last edge is the upper end itself."""
    return F.when(number == bins, high).otherwise(low + number * ((high - low) / bins))


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number of a value inside the range: half-open bins, the last one closed.

    The division may round a value across an edge, so the edges have the last word.
    """
    place = F.floor((value - low) / ((high - low) / bins))
    guess = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))
    return (
        F.when((guess > 0) & (value < _edge(low, high, bins, guess)), guess - 1)
        .when((guess < bins - 1) & (value >= _edge(low, high, bins, guess + 1)), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def _widened(low: Column, high: Column) -> tuple[Column, Column]:
    """A range without width becomes one of width 1 around its value."""
    flat = low == high
    return F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)


def _with_lookup(known: DataFrame, lookup: DataFrame, group: str, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows beside the one lookup row of their group, and that table as later joins should take it.

    A small lookup is broadcast; beyond that the rows of common groups are split by value.
    """
    side = small_side(lookup)
    return (split_join(known, lookup, group, col) if side is lookup else known.join(side, group)), side


def _all_bins(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


def histogram(
    df: DataFrame,
    col: str,
    bins: int = HISTOGRAM_BINS,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Rows per bin over a fixed range, or over the range of the data.

    NULL and values outside the range are left out; empty bins show 0.
    """
    value = F.col(col)
    if low is None or high is None:
        ends = F.struct(F.min(value).alias("low"), F.max(value).alias("high"))
    else:
        ends = F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    ends = df.agg(ends.alias("ends")).scalar() if low is None or high is None else ends
    low_end, high_end = _widened(F.col("_ends")["low"], F.col("_ends")["high"])
    counted = (
        df.select(col)
        .withColumn("_ends", ends)
        .where(value.isNotNull() & (value >= low_end) & (value <= high_end))
        .groupBy(_bin_of(value, low_end, high_end, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return (
        _all_bins(df, bins)
        .join(counted, "bin", "left")
        .withColumn("_ends", ends)
        .select(
            "bin",
            _edge(low_end, high_end, bins, F.col("bin")).alias("bin_start"),
            _edge(low_end, high_end, bins, F.col("bin") + 1).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def histogram_by(df: DataFrame, group: str, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density histogram per group, each over its own range; the bars of a group have area 1."""
    value = F.col(col)
    known = df.where(F.col(group).isNotNull() & value.isNotNull()).select(group, col)
    low, high = _widened(F.min(value), F.max(value))
    ranges = known.groupBy(group).agg(low.alias("low"), high.alias("high"), F.count("*").alias("total"))
    placed, ranges = _with_lookup(known, ranges, group, col)
    counted = (
        placed.groupBy(group, _bin_of(value, F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    width = (F.col("high") - F.col("low")) / bins
    return (
        ranges.select("*", numbers.alias("bin"))
        .join(counted, [group, "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            group,
            "bin",
            _edge(F.col("low"), F.col("high"), bins, F.col("bin")).alias("bin_start"),
            "n",
            (F.col("n") / (F.col("total") * width)).alias("density"),
        )
    )


def _curve_frame(value: Column, points: int) -> list[Column]:
    """Bandwidth (Scott's rule) and the grid, three bandwidths past the data on each side."""
    n = F.count(value)
    width = F.stddev_samp(value) * F.pow(n.cast("double"), F.lit(-0.2))
    start = F.min(value) - 3 * width
    step = (F.max(value) + 3 * width - start) / (points - 1)
    return [n.alias("n"), width.alias("h"), start.alias("start"), step.alias("step")]


def _heights(col: str, points: int) -> list[Column]:
    """One sum per grid point: values are read once and only the sums are shuffled."""
    z = f"((start + {{i}} * step - {col}) / h)"
    height = f"sum(exp({z} * {z} * -0.5e0)) as _{{i}}"
    return [F.expr(height.format(i=i)) for i in range(points)]


def _curve(summed: DataFrame, points: int, *keys: str) -> DataFrame:
    area = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return summed.select(
        *keys,
        "n",
        "h",
        "start",
        "step",
        F.expr(f"posexplode(array({', '.join(f'_{i}' for i in range(points))})) as (point, height)"),
    ).select(
        *keys,
        F.col("point").cast("int").alias("point"),
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        F.try_divide("height", area).alias("density"),
    )


def kde(df: DataFrame, col: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian density curve at ``points`` places; exact, every value counts."""
    value = F.col(col)
    known = df.where(value.isNotNull()).select(col)
    frame = known.agg(F.struct(*_curve_frame(value, points)).alias("f")).scalar()
    parts = ["n", "h", "start", "step"]
    placed = known.withColumn("_f", frame).select(col, *[F.col("_f")[p].alias(p) for p in parts])
    kept = [F.first(p).alias(p) for p in parts]
    return _curve(placed.where(F.col("h") > 0).agg(*kept, *_heights(col, points)), points)


def kde_by(df: DataFrame, group: str, col: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Density curve per group, each on its own grid. A group without spread has no curve."""
    value = F.col(col)
    known = df.where(F.col(group).isNotNull() & value.isNotNull()).select(group, col)
    frames = known.groupBy(group).agg(*_curve_frame(value, points)).where(F.col("h") > 0)
    placed, _ = _with_lookup(known, frames, group, col)
    kept = [F.first(p).alias(p) for p in ("n", "h", "start", "step")]
    summed = placed.groupBy(group).agg(*kept, *_heights(col, points))
    return _curve(summed, points, group)


def kde_binned(
    df: DataFrame,
    col: str,
    group: str | None = None,
    points: int = DENSITY_POINTS,
    per_bandwidth: int = BINS_PER_BANDWIDTH,
) -> DataFrame:
    """Density curve (per group) from binned values: rows are read once, whatever the number of points.

    Each value is shared between the two nearest centres of a fine grid, the nearer
    one getting more (linear binning). The kernel then runs over bins, and only
    over the points within ``REACH`` bandwidths. The curve differs from the exact one
    by at most ``1 / (8 * per_bandwidth ** 2)`` of the kernel's largest curvature, 3e-5 of
    the height of a lone value's bump as it stands. The number of bins depends on the range
    of the values in bandwidths. A group without spread has no curve.
    """
    keys = [group] if group else []
    value = F.col(col)
    known = df.where(value.isNotNull()).select(*keys, col)
    known = known.where(F.col(group).isNotNull()) if group else known
    frame = [*_curve_frame(value, points), F.min(value).alias("low")]
    framed = known.groupBy(*keys).agg(*frame).where(F.col("h") > 0)
    place = F.expr(f"({col} - low) / (h / {per_bandwidth})")
    beyond = place - F.floor(place)
    if group:
        placed, framed = _with_lookup(known, framed, group, col)
    else:  # one row
        placed = known.join(F.broadcast(framed))
    bins = placed.groupBy(*keys, F.floor(place).alias("bin")).agg(
        F.sum(1 - beyond).alias("here"), F.sum(beyond).alias("next")
    )
    bins = bins.join(F.broadcast(framed)) if not group else bins.join(framed, group)
    centre = F.col("low") + F.col("bin") * F.col("h") / per_bandwidth

    def nearest(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor((x - F.col("start")) / F.col("step")).cast("int")))

    reach = REACH * F.col("h")
    spread = bins.withColumn("_at", centre).withColumn(
        "point", F.explode(F.sequence(nearest(F.col("_at") - reach), nearest(F.col("_at") + reach)))
    )
    z = f"((start + point * step - _at - h / {per_bandwidth} * {{}}) / h)"
    bump = "{} * exp(-0.5e0 * {z} * {z})"
    height = F.expr(f"sum({bump.format('here', z=z.format(0))} + {bump.format('next', z=z.format(1))})")
    heights = spread.groupBy(*keys, "point").agg(height.alias("height"))
    numbers = framed.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    area = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return numbers.join(heights, [*keys, "point"], "left").select(
        *keys,
        "point",
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("height", F.lit(0e0)) / area).alias("density"),
    )
