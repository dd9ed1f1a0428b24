"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subsight.functions.ordered import range_cuts, running_totals
from subsight.sources.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words.
SHARE = 1.5
#: No source is taken more than so many times.
MOST = 2.0
SEED = 11


def size_of(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _positions(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last.

    Sources fall into ranges by their first two bytes; each range is ordered by
    its own task, and only one count per range meets in one place.
    """
    # Bytes and code points of UTF-8 sort alike; '~' is above any hex digit.
    prefix = F.coalesce(F.substring(F.hex(F.col("source").cast("binary")), 1, 4), F.lit("~"))
    ranged = sources.withColumn("_part", prefix)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("_part").orderBy("source")
    return ranged.join(starts, "_part").select(
        *sources.columns, (F.col("_start") + F.row_number().over(inside) - 1).alias("position")
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``(source, source_size, target, rate)`` from rows ``(source, size)``.

    Sources share ``share`` times all words by weight. None gets more than
    ``most`` times its own words; what lies above is shared again by weight
    among the others until none is above. That is one level: the target is the
    lesser of the cap and weight times level. Sources are taken in the order of
    cap by weight, and the level follows from the sums of the caps before and
    the weights after. A source without words has target and rate 0.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = (
        _positions(totals)
        .withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
    )
    weighed = materialize(weighed)
    # Equal fills are one step, so that the order is of a unique column.
    steps = weighed.groupBy("fill").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    summed = running_totals(steps, "fill", {"caps_upto": "caps", "weights_upto": "weights"}, range_cuts(steps, "fill"))
    whole = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights")
    ).first()
    wanted = whole["words"] * share
    # The level if all sources before a step are full and those from it on are not.
    open_weight = F.lit(float(whole["weights"])) - (F.col("weights_upto") - F.col("weights"))
    level = (F.lit(float(wanted)) - (F.col("caps_upto") - F.col("caps"))) / open_weight
    reached = summed.select("fill", level.alias("level")).where(F.col("level") <= F.col("fill"))
    first = reached.agg(F.min_by("level", "fill").alias("level")).first()["level"]
    target = F.col("cap") if first is None else F.least("cap", F.col("weight") * F.lit(first))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


#: Draws are numbers below 2 ** 60; their top bits tell the cell in which a bound is looked for.
DRAW_DIGITS = 15
CELL_BITS = 12


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, DRAW_DIGITS), 16, 10).cast("long")


def _draw(seed: int) -> Column:
    """A number below 2 ** 60 from id or text: the same in every run, apart for rows that differ."""
    return _number(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))


def _size_class(size: str) -> Column:
    """Eight classes for each doubling of the size, rising with it; 0 for size 0."""
    bits = f"length(bin({size}))"
    return F.expr(f"cast({bits} * 8 - 8 + shiftright({size} * 8, {bits} - 1) as int)")


def _sized(docs: DataFrame, seed: int, keep: tuple[str, ...]) -> DataFrame:
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _draw(seed).alias("_draw"), *keep)
    return rows.withColumn("_class", _size_class("size"))


def draw_bounds(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``(source, _class, source_size, target, rate, bound)``: whose draw gets the extra copy.

    The extra copies of a source are its documents times the fraction of its rate.
    They go round its size classes from small to large: a class gets the whole numbers
    that the running sum of fractions passes in it, starting at a hash of the source.
    So every document has the probability of the fraction, large ones are taken in turn
    with their likes, and the words come out near the target. In a class the smallest
    draws are taken, up to ``bound``: the draw of that rank, found by counts per cell
    and then by the draws of one cell. No document moves, equal draws go together,
    and they are counted before they meet.
    """
    cell = F.shiftright("_draw", 4 * DRAW_DIGITS - CELL_BITS)
    celled = rows.select("source", "_class", "_draw", cell.alias("_cell"))
    cells = materialize(celled.groupBy("source", "_class", "_cell").agg(F.count("*").alias("_n")))
    own = targets.withColumnRenamed("source", "_source")
    start = _number(F.concat_ws(":", F.lit(f"{seed}:source"), F.coalesce("source", F.lit("")))).cast("double")
    upto = F.sum("_n").over(W.partitionBy("source").orderBy("_class").rowsBetween(W.unboundedPreceding, 0))
    fraction = F.col("rate") - F.floor("rate")

    def passed(count: Column) -> Column:
        return F.floor(F.col("_start") + count * fraction)

    classes = (
        cells.groupBy("source", "_class")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", upto)
        .join(own, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_start", start / F.lit(float(16**DRAW_DIGITS)))
        .withColumn("_wanted", passed(F.col("_upto")) - passed(F.col("_upto") - F.col("_n")))
        .select("source", "_class", "source_size", "target", "rate", "_wanted")
    )
    classes = materialize(classes)

    def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
        found = left["source"].eqNullSafe(right["source"])
        for name in names:
            found &= left[name] == right[name]
        return found

    before = F.sum("_n").over(W.partitionBy("source", "_class").orderBy("_cell")) - F.col("_n")
    held = cells.withColumn("_before", before)
    last = F.col("_wanted") - F.col("_before")
    needed = (
        held.join(classes, same(held, classes, "_class"))
        .where((last > 0) & (last <= F.col("_n")))
        .select(held["source"], held["_class"], "_cell", last.alias("_last"))
    )
    # A cell of each class at most, and equal draws as one row.
    met = celled.join(needed, same(celled, needed, "_class", "_cell")).select(celled["source"], celled["_class"], "_draw", "_last")
    drawn = met.groupBy("source", "_class", "_draw", "_last").agg(F.count("*").alias("_n"))
    drawn = drawn.withColumn("_upto", F.sum("_n").over(W.partitionBy("source", "_class").orderBy("_draw")))
    bounds = drawn.where(F.col("_upto") >= F.col("_last")).groupBy("source", "_class").agg(F.min("_draw").alias("bound"))
    return classes.join(bounds, same(classes, bounds, "_class"), "left").select(
        classes["source"], classes["_class"], "source_size", "target", "rate", "bound"
    )


def plan_mix(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = (), **rules) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` per row.

    A document comes ``floor(rate)`` times, and once more with the probability of
    the rest, by a hash of its id (``draw_bounds``). Rows without id are drawn by their
    text. ``keep`` names further columns to carry. Sizes and draws are counted once
    and written. The table of bounds, a row per source and size class, is written too,
    so Spark knows its size and broadcasts it only if it is small; else a source that
    holds many rows is split by adaptive skew handling.
    """
    rows = materialize(_sized(docs, seed, ()))
    targets = materialize(source_targets(rows.select("source", "size"), **rules))
    bounds = materialize(draw_bounds(rows, targets, seed)).withColumnsRenamed({"source": "_source", "_class": "_own_class"})
    # Other columns are not written a second time: their rows are read from the documents again.
    drawn = _sized(docs, seed, keep) if keep else rows
    joined = drawn.join(bounds, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_own_class")))
    extra = F.coalesce(F.col("_draw") <= F.col("bound"), F.lit(False)).cast("int")
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), *keep,
    )


def mix(docs: DataFrame, seed: int = SEED, **rules) -> DataFrame:
    """The mix itself: each row as often as planned, with ``copy_no`` from 1.

    Other columns of ``docs`` stay, except one named ``copy_no``. Documents drawn
    zero times are not in the mix. Null texts have no words. An empty table
    gives an empty mix.
    """
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "source", "copy_no"))
    own = {c: f"_own_{i}" for i, c in enumerate(extra)}
    renamed = docs.select("doc_id", "source", "text", *[F.col(c).alias(n) for c, n in own.items()])
    planned = plan_mix(renamed, seed, tuple(own.values()), **rules).where("copies > 0")
    numbered = planned.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return numbered.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns if c != "copy_no"], "copy_no")
