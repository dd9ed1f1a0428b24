"""Repeatable randomness: the same row gets the same draw in every run and plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 7


def _as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash_text(key: str, *salt) -> Column:
    """md5 of ``key:salt:...`` as 32 hex digits; sorts rows in a random order."""
    parts = [F.col(key).cast("string")] + [_as_column(s).cast("string") for s in salt]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(key: str, *salt) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    bits = F.conv(F.substring(hash_text(key, *salt), 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296e0)
