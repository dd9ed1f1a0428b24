"""Names for helper columns beside those a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
