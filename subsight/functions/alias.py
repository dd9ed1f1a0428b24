"""Weighted draws by alias tables: one equality lookup a draw, however many categories there are.

A table for K categories has K slots of the same size. Each slot belongs to a
category and holds what its weight fills of it; the rest goes to one other category,
the alias. A draw picks a slot and then one of the two.
"""

from __future__ import annotations

import bisect
import hashlib
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.functions.intervals import assign_interval
from subsight.functions.ordered import range_cuts, running_totals, with_next
from subsight.sources.tables import materialize

#: Up to so many categories the table is made on the driver, from as many counts, and broadcast.
SMALL = 10_000
SCHEMA = "slot long, category string, kept double, alias string"
#: Hash digits that cut the categories into ranges for running sums.
RANGE_DIGITS = 3


def alias_rows(counts: list[tuple[str, int]]) -> list[tuple[int, str, float, str | None]]:
    """The table of a few categories; whole numbers throughout.

    Categories stand in hash order. Those that do not fill their slot lack a deficit, the
    others have a surplus. Along one line, with deficits beside surpluses, a light
    category is filled by the heavy one where its deficit begins; what that takes too
    much of the heavy one's own slot is filled by the next heavy one.
    """
    ordered = sorted(counts, key=lambda c: (hashlib.md5(c[0].encode()).hexdigest(), c[0]))
    slots, size = len(ordered), sum(n for _, n in ordered)
    heavy = [(c, n * slots - size) for c, n in ordered if n * slots >= size]
    ends = list(accumulate(s for _, s in heavy))
    deficits = list(accumulate(max(0, size - n * slots) for _, n in ordered))
    rows, seen = [], 0
    for slot, (category, n) in enumerate(ordered):
        if n * slots < size:
            begin = deficits[slot] - (size - n * slots)
            rows.append((slot, category, n * slots / size, heavy[bisect.bisect_right(ends, begin)][0]))
            continue
        # The deficit that stands across the end of this surplus.
        end = ends[seen]
        over = deficits[bisect.bisect_left(deficits, end)] - end if end else 0
        seen += 1
        rows.append((slot, category, (size - over) / size, heavy[seen][0] if over else None))
    return rows


def alias_table(counted: DataFrame) -> DataFrame:
    """The same table from ``(category, n)`` for any number of categories; no task holds all of them.

    Deficits and surpluses are running sums over ranges of the hash, and the heavy
    category where a deficit begins is an interval lookup.
    """
    counted = materialize(counted)
    slots, size = counted.agg(F.count("*"), F.sum("n")).first()
    whole = "decimal(38,0)"
    mass = F.col("n").cast(whole) * slots
    weighed = counted.select(
        "category",
        F.md5(F.col("category").cast("binary")).alias("hash"),
        F.greatest(size - mass, F.lit(0)).cast(whole).alias("lacks"),
        F.greatest(mass - size, F.lit(0)).cast(whole).alias("spare"),
        F.lit(1).alias("one"),
    )
    sums = {"lacking": "lacks", "sparing": "spare", "place": "one"}
    part = F.conv(F.substring("hash", 1, RANGE_DIGITS), 16, 10).cast("int")
    line = materialize(running_totals(weighed, "hash", sums, known_range=part))
    light, heavy = line.where("lacks > 0"), line.where("lacks = 0")
    spare = heavy.where("spare > 0").select(
        (F.col("sparing") - F.col("spare")).alias("lo"), F.col("sparing").alias("hi"), F.col("category").alias("alias")
    )
    lack = light.select((F.col("lacking") - F.col("lacks")).alias("lo"), F.col("lacking").alias("hi"))
    begins = light.withColumn("at", F.col("lacking") - F.col("lacks") + 1)
    filled = assign_interval(begins, spare, "at", band="alias").withColumn("over", F.col("lacks"))
    crossing = assign_interval(heavy, lack.withColumn("until", F.col("hi")), "sparing", band="until")
    crossing = crossing.withColumn("over", F.coalesce(F.col("until") - F.col("sparing"), F.lit(0)))
    following = with_next(crossing, "place", {"next": "category"}, range_cuts(crossing.select(F.col("place").cast("double")), "place"))
    topped = following.withColumn("alias", F.when(F.col("over") > 0, F.col("next")))
    columns = [
        (F.col("place") - 1).cast("long").alias("slot"),
        "category",
        ((size - F.col("over")).cast("double") / F.lit(float(size))).alias("kept"),
        "alias",
    ]
    return filled.select(*columns).unionByName(topped.select(*columns))


def picked(coin: Column, category: str = "category", kept: str = "kept", alias: str = "alias") -> Column:
    """The category of a slot, or its alias, by a number in [0, 1)."""
    return F.when(coin < F.col(kept), F.col(category)).otherwise(F.col(alias))
