"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments. If two
fingerprints differ in at most ``max_bits`` bits, some segment differs in at most
one. So each fingerprint is indexed under all its segments with one bit wiped
out, an equality join finds the fingerprints that share such a variant, and the
whole distance is checked inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.functions.joins import HOT_SHARE, split_join
from subsight.llm.components import connected
from subsight.llm.words import lower_words
from subsight.sources.tables import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Rows whose bits are added in one byte each, so that no sum exceeds 255.
BYTE_ROWS = 255
#: Shingles counted at once, to bound the memory a very long text takes.
BLOCK = BYTE_ROWS * 512


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(hashes) // BYTE_ROWS) * BYTE_ROWS, dtype="<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, BYTE_ROWS, 8), axis=2, bitorder="little")
    return bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text: a bit is set if over half of the shingles' hashes set it."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    count = max(1, len(words) - shingle_words + 1)
    last = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    first = starts[:count].tolist()
    totals = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        pairs = zip(first[at : at + BLOCK], last[at : at + BLOCK])
        hashes = [digest(joined[a:b], SEED) for a, b in pairs]
        totals += _bit_counts(np.array(hashes, dtype="<u8"))
    return int(np.packbits(totals * 2 > count, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fingerprint)`` for each row; the fingerprint is a signed 64-bit number.

    Null, empty and blank texts have fingerprint 0. Other columns are not read.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py(), shingle_words) for t in batch.column(1)]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=[id_col, "fingerprint"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(per_batch, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(max_bits: int) -> list[tuple[int, int]]:
    count = max_bits // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(lo: int, hi: int) -> int:
    return _signed(((1 << hi) - 1) ^ ((1 << lo) - 1))


def variants(fingerprint: Column, max_bits: int) -> Column:
    """All one-wildcard segment variants: the segment without bit i, and i itself in the low six bits."""
    keys = []
    for lo, hi in _segments(max_bits):
        for bit in range(lo, hi):
            kept = F.lit(_signed((_mask(lo, hi) & ~(1 << bit)) & (2**64 - 1))).cast("long")
            part = F.shiftrightunsigned(fingerprint.bitwiseAND(kept), lo)
            keys.append(F.shiftleft(part, 6).bitwiseOR(F.lit(bit).cast("long")))
    return F.array(*keys)


def _first_meeting(differs: Column, bit: Column, max_bits: int) -> Column:
    """True for one of the variants that two fingerprints share, so that a pair comes once."""
    found, earlier = [], F.lit(True)
    for lo, hi in _segments(max_bits):
        here = differs.bitwiseAND(F.lit(_mask(lo, hi)).cast("long"))
        alike = (here == 0) & (bit == lo)
        one_off = bit.between(lo, hi - 1) & (here == F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        found.append(earlier & (alike | one_off))
        earlier = earlier & (F.bit_count(here) > 1)
    return reduce(lambda a, b: a | b, found)


def near_pairs(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b, bits)``: all pairs a < b of different fingerprints that differ in few bits.

    ``classes`` has one row per fingerprint. Distance and uniqueness are checked
    as the join meets the rows, so only true pairs leave it; a variant shared by
    very many fingerprints is split over tasks by adaptive skew handling. Spark sizes the
    variants like the fingerprints they come from, 64 of them as one, and would broadcast far
    too many; so the join is a merge whatever Spark makes of their size.
    """
    keyed = classes.select("fingerprint", F.explode(variants(F.col("fingerprint"), max_bits)).alias("key"))
    left = keyed.select(F.col("fingerprint").alias("a"), "key")
    right = keyed.select(F.col("fingerprint").alias("b"), F.col("key").alias("other_key"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    bit = F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int")
    near = (
        (F.col("key") == F.col("other_key"))
        & (F.col("a") < F.col("b"))
        & (F.bit_count(differs) <= max_bits)
        & _first_meeting(differs, bit, max_bits)
    )
    return left.join(right.hint("merge"), near).select("a", "b", F.bit_count(differs).cast("int").alias("bits"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row.

    Equal fingerprints are one class; classes within ``max_bits`` bits are
    linked, and a component is all that links reach. ``component_id`` is the
    smallest id in it. Rows with a null id are placed like any other and give no
    name; a component of such rows only has a null ``component_id``. Repeated
    rows come back as often as they came. An empty table gives an empty one.
    Null and empty texts share fingerprint 0.
    """
    prints = materialize(add_fingerprint(docs, id_col, text_col, shingle_words))
    grouped = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped)
    rooted = materialize(connected(near_pairs(classes, max_bits), "a", "b"))
    linked = classes.join(rooted, F.col("fingerprint") == F.col("node")).select("fingerprint", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = rooted.join(names, "root").select(F.col("node").alias("fingerprint"), "component_id")
    of_class = classes.join(of_linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )
    rows = classes.agg(F.sum("n").alias("rows")).scalar()
    # Fewer than ``HOT_SHARE`` rows: the rows of a common fingerprint are split over tasks.
    hot = classes.where(F.col("n") * HOT_SHARE > rows).select("fingerprint")
    found = split_join(prints, of_class, "fingerprint", spread_by=id_col, hot=hot)
    return found.select(id_col, "fingerprint", "component_id")
