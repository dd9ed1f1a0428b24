"""Line deduplication over windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _windows(docs: DataFrame) -> DataFrame:
    """``(doc, at, h1, h2)``: each run of three lines that are not blank, as a hash of 128 bits."""
    lines = F.split("text", "\n")
    codes = F.transform(F.filter(F.transform(lines, _bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    coded = docs.where(F.instr("text", "\n") > 0).select(_doc().alias("doc"), codes.alias("codes"))
    count = F.greatest(F.size("codes") - (WINDOW - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("codes", i + 1, count).alias(f"c{i}") for i in range(WINDOW)])
    each = coded.where(F.size("codes") >= WINDOW).select("doc", F.posexplode(runs).alias("at", "run"))
    # arrays_zip names its fields by position or by column; they are taken in order here.
    parts = [F.col("run").getField(f.name) for f in each.schema["run"].dataType.fields]
    return each.select("doc", "at", F.xxhash64(*parts).alias("h1"), F.xxhash64(*parts[::-1]).alias("h2"))


def _doc() -> Column:
    """What tells documents apart and orders them: the id (null first), then the text's hash."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc, places)``: for each document, the windows that occur earlier in the corpus.

    Earlier is a smaller ``doc_id``, or a smaller place in the same document. The
    first place of each window is an aggregate that shrinks before its shuffle;
    it is joined back to the windows, where a window that very many documents
    share is split over tasks by adaptive skew handling.
    """
    windows = _windows(docs)
    place = F.struct("doc", "at")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    # A set: rows that repeat a document, however many, add no places.
    return later.groupBy("doc").agg(F.collect_set("at").alias("places"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove the lines that later occurrences of a window of three lines cover.

    Lines are compared without blanks at their ends. Blank lines are neither
    compared nor removed. A window found earlier in the corpus marks its three
    lines; overlapping windows merge, and all marked lines go. Texts of fewer
    than three such lines stay as they are, as do null and empty texts.
    Documents stay even if all their lines go; their text is then empty or
    blank. Rows that agree in ``doc_id`` and text are one document: they do not
    repeat each other and all get the same result. Null ids come before others.

    ``text`` is replaced, ``n_chars`` too where it exists, and ``lines_removed`` is
    added, or replaced. Other columns stay. An empty table gives an empty one.
    """
    kept = docs.drop("lines_removed")
    own = {c: f"_own_{i}" for i, c in enumerate(c for c in kept.columns if c not in ("doc_id", "text"))}
    rows = kept.select("doc_id", "text", *[F.col(c).alias(n) for c, n in own.items()], _doc().alias("_doc"))
    marked = repeated_windows(kept.select("doc_id", "text")).select(F.col("doc").alias("_marked"), "places")
    joined = rows.join(marked, F.col("_doc").eqNullSafe(F.col("_marked")), "left")
    lines = F.when(F.col("places").isNotNull(), F.split("text", "\n"))
    solid = F.filter(
        F.transform("_lines", lambda x, p: F.struct(p.alias("p"), _bare(x).alias("x"))), lambda s: s.x != ""
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda i: F.sequence(i, i + (WINDOW - 1)))))
    # Each array is read twice or more below, so Spark keeps it as a column of its own.
    dropped = F.when(F.size("_solid") > 0, F.transform(covered, lambda i: F.element_at("_solid", i + 1).p))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    text = F.array_join(F.transform("_stay", lambda p: F.element_at("_lines", p + 1)), "\n")
    cut = (
        joined.withColumn("_lines", lines)
        .withColumn("_solid", solid)
        .withColumn("_dropped", dropped)
        .withColumn("_stay", F.when(F.size("_dropped") > 0, stay))
        .withColumn("_text", F.when(F.col("_dropped").isNotNull(), text).otherwise(F.col("text")))
        .withColumn("_removed", F.coalesce(F.size("_lines") - F.size("_stay"), F.lit(0)))
    )
    values = {"text": F.col("_text"), "doc_id": F.col("doc_id")} | {c: F.col(n) for c, n in own.items()}
    if "n_chars" in values:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.col("_removed") > 0, F.length("_text").cast(kind)).otherwise(values["n_chars"])
    return cut.select(*[values[c].alias(c) for c in kept.columns], F.col("_removed").alias("lines_removed"))
