"""Readers and writers for the input and interchange tables."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.constants import PAID_CHANNELS
from subsight.schemas import TABLES


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL: Spark ranks NaN above every number, so ``x > 0`` would keep it."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in doubles})


def read_table(spark: SparkSession, directory: str, name: str, has_nan: bool = True) -> DataFrame:
    """Read one input table from parquet under its fixed schema.

    Numbers may be missing as NaN, as some tools write them; they become NULL.
    Clear ``has_nan`` for files without NaN: a rewritten column keeps its filters
    out of the parquet scan.
    """
    df = spark.read.schema(TABLES[name]).parquet(os.path.join(directory, f"{name}.parquet"))
    return nan_to_null(df) if has_nan else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV file with a header row under a given schema."""
    return nan_to_null(spark.read.option("header", True).schema(schema).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table as CSV with a header row, keeping its key columns."""
    df.write.mode(mode).option("header", True).csv(path)


def read_spend(spark: SparkSession, path: str) -> DataFrame:
    """Read the advertising-spend sheet, exported as CSV or parquet.

    The CSV export starts with banner and heading rows. They are told apart
    by their content, as position means nothing in a split file.
    """
    schema = TABLES["spend"]
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])

    def parsed(name: str) -> Column:
        return F.col(name).try_cast(schema[name].dataType).alias(name)

    return (
        spark.read.schema(raw)
        .csv(path)
        .where(F.col("period_idx").try_cast("int").isNotNull())
        .select("period_idx", *PAID_CHANNELS)
        .select(*[parsed(f.name) for f in schema.fields])
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder the cluster shares for checkpoints.

    That is ``spark.checkpoint.dir``. Without it the folder lies in the warehouse, as
    long as that is shared too: a folder of the driver's own machine is refused when
    the work is not done there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        local = warehouse.startswith(("file:", "/")) and not spark.conf.get("spark.hadoop.fs.defaultFS", "file:").startswith("hdfs")
        if local and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is not")
        base = f"{warehouse}/checkpoints"
    return f"{base.rstrip('/')}/subsight-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that many jobs will read and return a scan of it.

    The written copy cuts the lineage and outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
