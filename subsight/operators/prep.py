"""Preparation of the modelling table: pruning, filling, encoding, splitting, scaling."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.constants import (
    CATEGORICAL_FEATURES,
    FOLDS,
    IMPUTED_COLUMNS,
    MAX_NULL_PERCENT,
    NUMERIC_FEATURES,
    TEST_SHARE,
    UNUSED_COLUMNS,
)
from subsight.functions import alias
from subsight.functions.hashing import SEED, hash_text, hash_uniform
from subsight.functions.ordered import group_positions
from subsight.operators.counts import null_shares
from subsight.sources.tables import materialize

#: Hash digits counted in one pass of an exact split; a cell with at most so many rows is looked through.
PREFIX = 4
MAX_CELL = 10_000


def prune_null_columns(df: DataFrame, max_percent: float = MAX_NULL_PERCENT) -> DataFrame:
    """Keep the columns whose share of NULL is below ``max_percent``.

    The columns of the result depend on the data, so one aggregate runs now.
    """
    kept = {
        row["column_name"]
        for row in null_shares(df).where(F.col("null_percent") < max_percent).collect()
    }
    return df.select(*[c for c in df.columns if c in kept])


def drop_unused(df: DataFrame, cols: list[str] = UNUSED_COLUMNS) -> DataFrame:
    """Drop columns no analysis uses; names that are already gone are fine."""
    return df.drop(*cols)


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of each category of each column, as text: ``column_name, category, n``."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([], cols, "column_name", "category")
        .where(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(F.count("*").alias("n"))
    )


def impute_by_frequency(
    df: DataFrame, cols: list[str] = IMPUTED_COLUMNS, key: str = "subid", seed=SEED
) -> DataFrame:
    """Fill NULL categories with a draw weighted by how frequent each category is.

    The draw is a hash of the key, so a row is always filled the same way. It goes
    through an alias table: a slot by one equality join, then one of the slot's two
    categories. Counts come to the driver only while there are few; else the table
    is made and joined by slot, where draws spread evenly. A column without any
    category stays NULL.
    """
    counted = category_counts(df, cols)
    few = counted.limit(alias.SMALL + 1).collect()
    small = len(few) <= alias.SMALL
    for name in cols:
        if small:
            rows = alias.alias_rows([(r["category"], r["n"]) for r in few if r["column_name"] == name])
            slots = len(rows)
            table = F.broadcast(df.sparkSession.createDataFrame(rows, alias.SCHEMA))
        else:
            table = materialize(alias.alias_table(counted.where(F.col("column_name") == name).drop("column_name")))
            slots = table.count()
        # Rows with a value have a slot too, so that they spread evenly in a shuffled join.
        slot = F.floor(hash_uniform(key, name, seed) * slots)
        drawn = df.withColumns({"_slot": slot, "_coin": hash_uniform(key, name, "coin", seed)})
        lookup = table.select(F.col("slot").alias("_slot"), F.col("category").alias("_own"), "kept", F.col("alias").alias("_other"))
        value = alias.picked(F.col("_coin"), "_own", "kept", "_other").cast(df.schema[name].dataType)
        filled = drawn.join(lookup, "_slot", "left").withColumn(name, F.coalesce(F.col(name), value))
        df = filled.select(*df.columns)
    return df


def one_hot(df: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> tuple[DataFrame, list[str]]:
    """Replace categories by 0/1 columns ``column_value``; none is left out, NULL is all 0.

    A boolean column stays one 0/1 column. Returns the names of the new columns.
    """
    encoded: dict[str, Column] = {}
    texts = [c for c in cols if not isinstance(df.schema[c].dataType, T.BooleanType)]
    seen = df.select(*[F.col(c).cast("string").alias(c) for c in texts])
    pairs = (
        seen.unpivot([], texts, "column_name", "category")
        .where(F.col("category").isNotNull())
        .distinct()
        .orderBy("column_name", "category")
        .collect()
    )
    for name in cols:
        value = F.col(name)
        if name not in texts:
            encoded[name] = F.coalesce(value.cast("int"), F.lit(0))
            continue
        for category in [p["category"] for p in pairs if p["column_name"] == name]:
            hit = F.coalesce((value.cast("string") == category).cast("int"), F.lit(0))
            encoded[f"{name}_{category}"] = hit
    kept = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*kept, *[c.alias(n) for n, c in encoded.items()]), list(encoded)


def is_test_row(key: str = "subid", share: float = TEST_SHARE, seed=SEED) -> Column:
    """True for the rows held out; decided by the key alone."""
    return hash_uniform(key, "split", seed) < share


def split(
    df: DataFrame, share: float = TEST_SHARE, key: str = "subid", seed=SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows."""
    held_out = is_test_row(key, share, seed)
    return df.where(~held_out), df.where(held_out)


def split_bound(df: DataFrame, share: float = TEST_SHARE, key: str = "subid", seed=SEED) -> str:
    """The largest hash of a test row, such that exactly ``ceil(share * rows)`` rows are test rows.

    Selects the k-th smallest hash by counts per prefix, without moving a row: at
    most ``16 ** PREFIX`` counts come back for each of one to three passes over the
    key, then the hashes of one cell. Rows that repeat a key stand on the same side.
    """
    hashes = df.select(hash_text(key, "split", seed).alias("_hash"))
    prefix, wanted = "", None
    while True:
        inside = hashes.where(F.col("_hash").startswith(prefix)) if prefix else hashes
        cell = F.substring("_hash", 1, len(prefix) + PREFIX).alias("cell")
        counted = sorted((r["cell"], r["n"]) for r in inside.groupBy(cell).agg(F.count("*").alias("n")).collect())
        if wanted is None:
            wanted = math.ceil(share * sum(n for _, n in counted))
            if not wanted:
                return ""
        for prefix, n in counted:
            if wanted <= n:
                break
            wanted -= n
        if n <= MAX_CELL or len(prefix) >= 32:
            break
    last = hashes.where(F.col("_hash").startswith(prefix)).orderBy("_hash").limit(wanted)
    return last.agg(F.max("_hash")).first()[0]


def is_within(bound: str, key: str = "subid", seed=SEED) -> Column:
    """True for the rows held out by a bound of ``split_bound``."""
    return hash_text(key, "split", seed) <= bound


def exact_split(
    df: DataFrame, share: float = TEST_SHARE, key: str = "subid", seed=SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; exactly ``ceil(share * rows)`` are test rows. ``df`` is read more than once."""
    held_out = is_within(split_bound(df, share, key, seed), key, seed)
    return df.where(~held_out), df.where(held_out)


def stratified_folds(
    df: DataFrame, label: str = "churn", key: str = "subid", k: int = FOLDS, seed=SEED, within: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``fold`` 0..k-1 so that the rows of a class are dealt evenly: counts differ by one at most.

    Rows are numbered in hash order inside each class (and inside ``within``) over
    ranges of the hash, so no task orders a whole class. NULL is a class too.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (*within, label)]
    hashed = df.withColumn("_hash", hash_text(key, "fold", seed)).withColumns(
        {"_class": F.concat_ws(":", *names), "_step": F.substring("_hash", 1, PREFIX)}
    )
    numbered = group_positions(hashed, "_class", "_step", "_hash")
    return numbered.withColumn("fold", (F.col("position") % k).cast("int")).drop("_hash", "_class", "_step", "position")


def fold_of(key: str = "subid", k: int = FOLDS, seed=SEED) -> Column:
    """Fold number 0..k-1, decided by the key alone."""
    return F.floor(hash_uniform(key, "fold", seed) * k).cast("int")


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column gives 0."""
    return F.when(value.isNotNull(), F.coalesce(F.try_divide(value - low, high - low), F.lit(0e0)))


def scaling_ranges(train: DataFrame, cols: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """One row with ``<col>_min`` and ``<col>_max`` of the train rows."""
    return train.agg(
        *[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols]
    )


def minmax(df: DataFrame, train: DataFrame, cols: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Scale columns by the range seen in ``train``; rows outside it are not clipped."""
    ranges = scaling_ranges(train, cols).select(F.struct("*").alias("r")).scalar()
    return (
        df.withColumn("_r", ranges)
        .withColumns({c: scaled(F.col(c), F.col("_r")[f"{c}_min"], F.col("_r")[f"{c}_max"]) for c in cols})
        .drop("_r")
    )


def assemble(df: DataFrame, cols: list[str], output: str = "features") -> DataFrame:
    """Collect feature columns into one vector."""
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="error").transform(df)
