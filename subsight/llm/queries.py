"""The driver's queries over the operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsight.llm import (
    decontaminate,
    fingerprints,
    html_text,
    langid,
    line_dedup,
    mixing,
    packing,
    phrases,
    pseudonyms,
    simhash,
    toxicity,
    warc,
    whitening,
)

#: For these tests only; whoever runs the operator brings a secret key.
PSEUDONYM_KEY = b"subsight test key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through Zstandard WARC archives and back."""
    found = warc.through_archives(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of windows seen before."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lines_removed")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    planned = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.replace_personal_data(docs, PSEUDONYM_KEY).select(
        "doc_id", "text", F.to_json("found").alias("found")
    )


def op6_simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of each document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(_table(spark, sf_dir, "pages")).drop("shared_lines")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents from a model that saw no held-out label."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train_on_open(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.add_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents from a model that saw no held-out document."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.is_held_out()))
    found = langid.add_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words belong together most."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces packed into sequences of 2,048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of all embeddings."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_line_windows": op2_line_windows,
    "op3_source_mix": op3_source_mix,
    "op4_minhash_fingerprints": op4_minhash_fingerprints,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_simhash_neighbours": op6_simhash_neighbours,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_passages": op9_benchmark_passages,
    "op10_language": op10_language,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_packed_sequences": op12_packed_sequences,
    "op13_whitened_embeddings": op13_whitened_embeddings,
}
