"""Interval lookup for tables of bands of any size."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.functions.joins import split_join
from subsight.functions.ordered import range_cuts

#: Cells hold about so many bounds, up to the largest number of cells.
BOUNDS_PER_CELL = 16
MAX_CELLS = 8192
#: An index over at most so many bands is broadcast; a larger one is joined by cell, common cells split.
MAX_BROADCAST_BANDS = 100_000


def _place(value: Column, kind: T.DataType) -> Column:
    """A number that rises with the value; values alike in it may still differ."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def _with_cell(df: DataFrame, value: Column, kind: T.DataType, cuts: list[float], name: str) -> DataFrame:
    """Add the number of the cell a value lies in; NULL and NaN get the number after the last."""
    splits = [float("-inf"), *cuts, float("inf")]
    placed = df.withColumn("_place", _place(value, kind))
    cutter = Bucketizer(splits=splits, inputCol="_place", outputCol=name, handleInvalid="keep")
    return cutter.transform(placed).drop("_place").withColumn(name, F.col(name).cast("int"))


def _overlapping_runs(spans: DataFrame) -> DataFrame:
    """The best ``rank`` of each run of a power of two cells, two of which make up a span ``[a, b)``."""
    run = F.expr("cast(shiftleft(1, length(bin(b - a)) - 1) as int)")
    return (
        spans.withColumn("run", run)
        .select("rank", "run", F.explode(F.array_distinct(F.array(F.col("a"), F.col("b") - F.col("run")))).alias("a"))
        .groupBy("run", "a")
        .agg(F.min("rank").alias("rank"))
        .select("rank", "a", (F.col("a") + F.col("run")).alias("b"))
    )


def interval_index(bands: DataFrame, low: str, high: str, band: str) -> tuple[DataFrame, list[float], int]:
    """Bands ``(low, high]`` by the cells of the line they touch; with the cuts of the cells and the number of bands.

    A NULL bound is open; a band without width holds nothing. Cells are cut at
    quantiles of the bounds. In a cell, ``candidates`` are the bands with a bound in it,
    one for each pair of bounds, and ``cover`` is the best of all bands that span it.
    A band touches the cells of its two bounds, and a row for each run of cells
    between; so overlaps cost no more than the cells, not bands times bands. Of two
    bands the one with the smaller ``high`` is the better one, then the smaller ``band``.
    """
    kind = bands.schema[high].dataType
    known = bands.select(F.col(low).alias("lo"), F.col(high).alias("hi"), F.col(band).alias("band")).where(
        F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") < F.col("hi"))
    )
    number = known.count()
    cells = max(1, min(MAX_CELLS, 2 * number // BOUNDS_PER_CELL))
    bounds = known.select(_place(F.col("lo"), kind).alias("at")).unionByName(
        known.select(_place(F.col("hi"), kind).alias("at"))
    )
    cuts = [c for c in range_cuts(bounds.where(F.col("at").isNotNull()).distinct(), "at", cells) if math.isfinite(c)]
    cuts = cuts or [0.0]
    cells = len(cuts) + 1
    group = math.isqrt(cells - 1) + 1
    celled = _with_cell(_with_cell(known, F.col("lo"), kind, cuts, "c0"), F.col("hi"), kind, cuts, "c1")
    celled = celled.withColumns(
        {
            "c0": F.when(F.col("lo").isNull(), -1).otherwise(F.col("c0")),
            "c1": F.when(F.col("hi").isNull(), cells).otherwise(F.col("c1")),
            "rank": F.struct(F.col("hi").isNull().alias("open"), "hi", "band"),
        }
    )
    edges = (
        celled.withColumn("cell", F.explode(F.array_distinct(F.array("c0", "c1"))))
        .where(F.col("cell").between(0, cells - 1))
        .groupBy(
            "cell",
            F.when(F.col("c0") == F.col("cell"), F.col("lo")).alias("lo"),
            F.when(F.col("c1") == F.col("cell"), F.col("hi")).alias("hi"),
        )
        .agg(F.min("rank").alias("rank"))
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("candidates"))
    )
    # Cells between the bounds: two runs of a power of two that overlap. The best of each run is taken before
    # runs are cut, so that what follows grows with the cells and not with the bands.
    spans = celled.where(F.col("c1") - F.col("c0") > 1).select(
        "rank", (F.col("c0") + 1).alias("a"), F.col("c1").alias("b")
    )
    spans = _overlapping_runs(spans)
    # Whole groups of cells, and single cells before and after those.
    spans = spans.withColumns({"ga": F.expr(f"(a + {group - 1}) div {group}"), "gb": F.expr(f"b div {group}")})
    steps = F.expr(
        "CASE WHEN ga < gb THEN concat("
        f"filter(sequence(a, ga * {group}), x -> x < ga * {group}), filter(sequence(gb * {group}, b), x -> x < b), "
        "transform(filter(sequence(ga, gb), x -> x < gb), x -> -1 - x)) "
        "ELSE filter(sequence(a, b), x -> x < b) END"
    )
    best = spans.select("rank", F.explode(steps).alias("step")).groupBy("step").agg(F.min("rank").alias("rank"))
    inside = F.sequence((-1 - F.col("step")) * group, F.least((-F.col("step")) * group, F.lit(cells)) - 1)
    single = best.where("step >= 0").select(F.col("step").cast("int").alias("cell"), "rank")
    wide = best.where("step < 0").select(F.explode(inside.cast("array<int>")).alias("cell"), "rank")
    cover = single.unionByName(wide).groupBy("cell").agg(F.min("rank").alias("cover"))
    return edges.join(cover, "cell", "full_outer"), cuts, number


def assign_interval(
    df: DataFrame, bands: DataFrame, value: str, low: str = "lo", high: str = "hi", band: str = "band"
) -> DataFrame:
    """Add ``band``: of the bands ``(low, high]`` that hold ``value`` the one that ends first, else NULL.

    The lookup is an equality join on the cell of the value, whatever the number of
    bands, and a search of the few candidates of that cell. A small index is
    broadcast; with a large one the rows of common cells are split over tasks. The
    bands are read, not collected; only the cuts of the cells reach the driver.
    """
    index, cuts, number = interval_index(bands, low, high, band)
    rows = _with_cell(df, F.col(value), bands.schema[high].dataType, cuts, "_cell")
    index = index.withColumnRenamed("cell", "_cell")
    if number <= MAX_BROADCAST_BANDS:
        joined = rows.join(F.broadcast(index), "_cell", "left")
    else:
        spread = rows.withColumn("_spread", F.xxhash64(*df.columns))
        joined = split_join(spread, index, "_cell", "_spread", "left").drop("_spread")

    def holds(c: Column) -> Column:
        x = F.col(value)
        return (c["lo"].isNull() | (x > c["lo"])) & (c["hi"].isNull() | (x <= c["hi"]))

    found = F.try_element_at(F.filter("candidates", holds), F.lit(1))["rank"]
    known = F.when(F.col(value).isNotNull(), F.least(found, "cover"))
    return joined.withColumn(band, known["band"]).select(*df.columns, band)
