"""Broadcasts only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Ready ``df`` for a join with a large table.

    Fetches at most ``max_rows + 1`` rows. If they are all, they go into the
    plan as a broadcast table, so the aggregate behind them is not run twice.
    If there are more, ``df`` comes back as it was and the join shuffles.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
