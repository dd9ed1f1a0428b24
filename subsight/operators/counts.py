"""Row profiles and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First rows in a stated order (a table has no order of its own)."""
    return df.orderBy(*order).limit(n)


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, number of rows, number and list of columns."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value (or combination), NULL left out, most frequent first."""
    return (
        df.dropna(subset=list(cols))
        .groupBy(*cols)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), *cols)
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Values of a column, NULL left out."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def null_shares(df: DataFrame) -> DataFrame:
    """Percentage of NULL per column, as rows ``(column_name, null_percent)``; one pass."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    return shares.unpivot([], df.columns, "column_name", "null_percent")


def wide_to_long(df: DataFrame, key: str, cols: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column; cells that are NULL stay."""
    return df.unpivot([key], cols, name, value)


def long_to_wide(df: DataFrame, key: str, name: str, names: list, value: str) -> DataFrame:
    """One column per listed name. The list is given, so no job runs to find it."""
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def text_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast columns to text, to stack columns of different types."""
    return df.withColumns({c: F.col(c).cast(T.StringType()) for c in cols})
