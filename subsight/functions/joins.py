"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1000
SALTS = 64


def hot_share(spark: SparkSession) -> int:
    """A key with more than one such part of all rows outgrows its share of a shuffle."""
    return max(HOT_SHARE, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """Keys with more than one ``share``-th of all rows; there are fewer than ``share`` of them."""
    share = share or hot_share(df.sparkSession)
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    rows = counted.agg(F.sum("_n").alias("rows")).scalar()
    return counted.where(F.col(key).isNotNull() & (F.col("_n") * share > rows)).select(key)


def split_join(
    large: DataFrame, lookup: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = SALTS,
    hot: DataFrame | list | None = None,
) -> DataFrame:
    """Join a table whose keys repeat to one where they do not, splitting the hot keys.

    Rows of a hot key are spread over ``salts`` parts by a column that varies
    within the key, and only its lookup row is copied to each part. All other
    keys are joined as usual, and all keys if ``hot`` is an empty list. ``how`` may be inner, left or left_semi. ``hot`` may
    give the hot keys where they can be told from a cheaper table than ``large``, as a
    table or as a list of values.
    """
    if isinstance(hot, list):
        if not hot:
            return large.join(lookup, key, how)
        kind = T.StructType([T.StructField(key, lookup.schema[key].dataType)])
        hot = large.sparkSession.createDataFrame([(value,) for value in hot], kind)
    hot = F.broadcast((hot_keys(large, key) if hot is None else hot).withColumn("_hot", F.lit(True)))
    part = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = large.join(hot, key, "left").withColumn(
        "_part", F.when(F.col("_hot"), part).otherwise(F.lit(0))
    )
    copied = lookup.join(hot, key, "left").withColumn("_part", F.explode(parts))
    return spread.drop("_hot").join(copied.drop("_hot"), [key, "_part"], how).drop("_part")
