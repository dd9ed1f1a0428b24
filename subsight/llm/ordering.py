"""Rows in the order of a key, streamed so that each row can see the next one."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.functions.ordered import range_cuts

#: Ranges there are at least and at most; between them, one for so many rows. Each gives one row to the driver.
RANGES = 1024
MAX_RANGES = 1 << 16
ROWS_PER_RANGE = 20_000
#: Stands for a null key, so that such rows come last.
LAST = 2**63 - 1


def in_order(df: DataFrame, key: str, ties: str, ranges: int | None = None) -> DataFrame:
    """Deal ``df`` into sorted ranges of a whole-number key; no task sorts all rows.

    The result is sorted within partitions by ``_range``, ``_after`` and the key
    (nulls last, equal keys by ``ties``). After the rows of a range come, with
    ``_after`` 1, the rows with the first key of the next range; after the last
    range those of the first range. So in a scan of a partition each row's
    successor is the row after it. The cuts, fewer than ``ranges`` numbers, decide
    how even the work is, not the result. Unless given, ``ranges`` rises with the rows.
    """
    ranges = ranges or min(MAX_RANGES, max(RANGES, df.count() // ROWS_PER_RANGE))
    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn(
        "_place", F.col("_key").cast("double")
    )
    cuts = range_cuts(keyed, "_place", ranges)
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_place", outputCol="_range")
    ranged = cutter.transform(keyed).withColumn("_range", F.col("_range").cast("int")).drop("_place")
    # At most ``ranges`` rows come to the driver.
    firsts = ranged.groupBy("_range").agg(F.min("_key").alias("_key")).orderBy("_range").collect()
    before = [(r["_key"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    known = F.broadcast(df.sparkSession.createDataFrame(before, "_key long, _earlier int"))
    own = F.struct(F.col("_range"), F.lit(0).alias("_after"))
    again = F.struct(F.col("_earlier").alias("_range"), F.lit(1).alias("_after"))
    places = F.when(F.col("_earlier").isNull(), F.array(own)).otherwise(F.array(own, again))
    dealt = ranged.join(known, "_key", "left").withColumn("_at", F.explode(places))
    return (
        dealt.drop("_range", "_earlier")
        .select("*", "_at.*")
        .drop("_at")
        .repartition("_range")
        .sortWithinPartitions("_range", "_after", "_key", ties)
    )
