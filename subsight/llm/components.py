"""Connected components of a graph given by its links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.sources.tables import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected(links: DataFrame, u: str, v: str) -> DataFrame:
    """One row ``(node, root)`` for each node of ``links``; root is the least node it reaches.

    Rounds of large-star and small-star: each node hangs its larger, then its
    smaller neighbours under the least one it sees, until nothing changes. The
    rounds are few, about the logarithm of a component's size. A node's
    neighbours are never gathered: their least is an aggregate, and joining it
    back splits over tasks when a node has very many. Each round is written to
    the shared folder, so a lost executor costs one round at most. Links with a
    null end or from a node to itself, and repeated links, add nothing.
    """
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    )
    edges = materialize(edges.distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.withColumnRenamed("m", "v"))
            .distinct()
        )
        edges = materialize(small)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)
