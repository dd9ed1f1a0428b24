"""The corpus pipeline: documents in, a clean and mixed training set out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from subsight.llm.columns import unused_name
from subsight.sources.tables import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of 0.7 or more; the model learns from rows that are not held out.

    Each row is judged by its whole text, however long. Null and empty texts score
    like a text without known terms and stay; rows that repeat or lack an id are
    judged one by one, ties in the score alike. An empty table gives an empty one.
    Other columns stay, one named ``score`` too.
    """
    model = toxicity.train_on_open(docs, _table(spark, sf_dir, "labels"))
    if "score" not in docs.columns:
        return toxicity.add_score(docs, model).where(F.col("score") < toxicity.THRESHOLD).drop("score")
    own = unused_name(docs, "own_score")
    scored = toxicity.add_score(docs.withColumnRenamed("score", own), model)
    kept = scored.where(F.col("score") < toxicity.THRESHOLD).drop("score")
    return kept.withColumnRenamed(own, "score").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines of three-line windows that came before.

    Every row stays, with its id and other columns. Null texts stay null, texts of
    fewer than three lines as they are; of equal windows the first in the order of
    ids stays. An empty table gives an empty one.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component: that with the smallest id, of equal ids the smallest text hash.

    A row is told by its id and a hash of its text, so texts that share an id, or have
    none, are placed and kept by themselves; rows without an id give way to those with
    one. Of rows that repeat id and text one stays. Null and empty texts are one
    component. An empty table gives an empty one. Other columns stay.
    """
    row = unused_name(docs, "row_key")
    text = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    keyed = docs.withColumn(row, F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", text.alias("text_hash")))
    placed = simhash.near_duplicates(keyed, id_col=row)
    first = placed.select(F.col("component_id").alias(row)).distinct()
    # Repeated rows shrink to one before they move, and both steps deal by the same key.
    return keyed.dropDuplicates([row]).join(first, row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Each row is searched by its whole text. Null and empty texts hold none; rows that
    repeat or lack an id are searched one by one. An empty table, of documents or of
    items, drops nothing. Other columns stay.
    """
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until the sources have their target weights.

    A null source is one of its own. Null and empty texts have size 0 and come as
    often as their source's rate says. Rows that share an id share its draw. An empty
    table gives an empty one. Other columns stay.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Learned scores and bit hashes are beyond SQL; tests check the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
