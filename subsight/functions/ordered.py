"""Work that needs a total order, done without a single-task sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subsight.functions.hashing import hash_text

RANGES = 512
HASH_DIGITS = 4


def range_cuts(df: DataFrame, col: str, ranges: int = RANGES) -> list[float]:
    """Values that cut a column into ranges of about the same number of rows.

    One pass over ``df`` with a mergeable sketch; fewer than ``ranges`` numbers
    come back. Rows may repeat a value: a range holds no more distinct values
    than rows.
    """
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(col, shares, 1 / (4 * ranges))))


def _add_range(df: DataFrame, order: str, cuts: list[float]) -> DataFrame:
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    splits = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=order, outputCol="_range", handleInvalid="keep")
    return cutter.transform(df).withColumn("_range", F.col("_range").cast("int"))


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    cuts: list[float] | None = None,
    descending: bool = False,
    known_range: Column | None = None,
) -> DataFrame:
    """Add running sums (including the own row) over the order of a unique column.

    Rows are split into ranges of the order column; each range is summed by its
    own task and the totals of the ranges before it are added on. Only the
    range totals, one row per range, meet in one place. The cuts decide how
    even the work is, not the result.

    ``sums`` maps new column to summed column. ``cuts`` come from
    ``range_cuts``; ``known_range`` may give the range directly and must rise
    with ``order``.
    """
    ranged = (
        _add_range(df, order, cuts or [])
        if known_range is None
        else df.withColumn("_range", known_range)
    )
    direction = F.desc if descending else F.asc
    before = W.orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*[F.sum(source).alias(f"_total_{name}") for name, source in sums.items()])
        .select(
            "_range",
            *[
                F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
                for name in sums
            ],
        )
    )
    inside = W.partitionBy("_range").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumns({name: F.sum(source).over(inside) for name, source in sums.items()})
    # One row per range on the small side. A left join, as an inner one would
    # push a check of the range down to the raw rows.
    joined = summed.join(F.broadcast(offsets), "_range", "left")
    return joined.withColumns(
        {name: F.col(name) + F.col(f"_before_{name}") for name in sums}
    ).drop("_range", *[f"_before_{name}" for name in sums])


def with_next(
    df: DataFrame, order: str, values: dict[str, str], cuts: list[float] | None = None, descending: bool = False
) -> DataFrame:
    """Add values of the next row in the order of a unique column; NULL in the last row.

    ``values`` maps new column to the one it is taken from. Each range of the order is
    sorted by its own task, and the last row of a range looks at the first of the
    next one: one row per range meets the others in one place.
    """
    ranged = _add_range(df, order, cuts or [])
    direction, first_by = (F.desc, F.max_by) if descending else (F.asc, F.min_by)
    row = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    after = F.lead("_first").over(W.orderBy(direction("_range"))).alias("_after")
    firsts = ranged.groupBy("_range").agg(first_by(row, order).alias("_first")).select("_range", after)
    inside = F.lead(row).over(W.partitionBy("_range").orderBy(direction(order)))
    seen = ranged.withColumn("_next", inside).join(F.broadcast(firsts), "_range", "left")
    following = F.coalesce("_next", "_after")
    return seen.withColumns({name: following[name] for name in values}).drop("_range", "_next", "_after")


def exact_median(df: DataFrame, col: str) -> Column:
    """Exact median as a scalar subquery; the built-in one holds all values in one task."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, col, {"upto": "n"}, range_cuts(df, col)).withColumn(
        "rows", counted.agg(F.sum("n").alias("rows")).scalar()
    )

    def value_at(rank: Column) -> Column:
        holds = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        return F.max(F.when(holds, F.col(col)))

    lower = F.floor((F.col("rows") + 1) / 2)
    upper = F.floor((F.col("rows") + 2) / 2)
    return ranked.agg(((value_at(lower) + value_at(upper)) / 2).alias("median")).scalar()


def ranked_sample(df: DataFrame, n: int, key: str, seed, by: tuple[str, ...] = ()) -> DataFrame:
    """Draw exactly ``n`` rows (per group), without replacement, with their draw order.

    Adds ``sample_rank`` 1..n. Rows are drawn in hash order, in two passes over
    ``df``: a count per hash prefix shows which prefixes the first ``n`` rows fill, and
    only rows of those are moved and ranked, each prefix by its own task. Beyond the
    ``n`` rows of a group that is at most the prefix in which its sample ends, 1 in
    ``16 ** HASH_DIGITS`` of its rows.
    """
    drawn = df.withColumn("_hash", hash_text(key, seed, *[F.col(c) for c in by])).withColumn(
        "_prefix", F.substring("_hash", 1, HASH_DIGITS)
    )
    before = W.partitionBy(*by).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    # At most 16 ** HASH_DIGITS cells per group are counted, and at most n that hold rows are needed.
    cells = (
        drawn.groupBy(*by, "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < n)
        .drop("_n")
    )
    inside = W.partitionBy(*by, "_prefix").orderBy("_hash", key)
    return (
        drawn.join(F.broadcast(cells), [*by, "_prefix"])
        .withColumn("sample_rank", F.col("_before") + F.row_number().over(inside))
        .where(F.col("sample_rank") <= n)
        .select(*df.columns, "sample_rank")
    )


def group_positions(df: DataFrame, group: str, coarse: str, fine: str) -> DataFrame:
    """Number the rows of each group from 0 in the order ``(coarse, fine)`` as ``position``.

    Counts per coarse step give each step its start, so a group is split over
    its steps and a very large one is never sorted by a single task.
    """
    steps = df.groupBy(group, coarse).agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy(coarse).rowsBetween(W.unboundedPreceding, -1)
    starts = steps.select(group, coarse, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(group, coarse).orderBy(fine)
    return (
        df.withColumn("_in_step", F.row_number().over(inside))
        .join(starts, [group, coarse])
        .withColumn("position", F.col("_start") + F.col("_in_step") - 1)
        .drop("_start", "_in_step")
    )
