"""Document fingerprints by one-permutation MinHash.

Each shingle of a text is hashed once. The high bits of the hash choose one of
``BINS`` bins, and each bin keeps its least hash. An empty bin copies the bin that
a fixed random sequence of its own finds first (optimal densification). Of each
bin only the low ``BITS`` bits are stored, packed and written as hex digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.llm.columns import unused_name
from subsight.llm.ordering import in_order
from subsight.llm.words import WordHashes, lower_words, mixed, shingle_hashes

BINS = 512
BITS = 4
SHINGLE_WORDS = 5
ROWS_OUT = 2000


class _Probes(dict):
    """Where the empty bins look in their n-th try; the same for every text."""

    def __missing__(self, attempt: int) -> np.ndarray:
        seeds = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS + 1)
        places = (mixed(seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)
        if attempt < 4096:
            self[attempt] = places
        return places


_PROBES = _Probes()


def codes_of(hashes: np.ndarray) -> np.ndarray | None:
    """The low bits of each bin's least hash; None without shingles."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    bins = (ordered >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(bins)) + 1))
    codes = np.zeros(BINS, dtype=np.uint8)
    filled = np.zeros(BINS, dtype=bool)
    codes[bins[first]] = (ordered[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    filled[bins[first]] = True
    if len(first) == 1:
        codes[:] = codes[bins[0]]
        return codes
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        found = _PROBES[attempt][empty]
        full = filled[found]
        codes[empty[full]] = codes[found[full]]
        empty, attempt = empty[~full], attempt + 1
    return codes


def packed(codes: np.ndarray | None) -> str:
    """Bin codes as hex digits, first bin first; no shingles give the empty string."""
    if codes is None:
        return ""
    bits = np.unpackbits(codes[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).reshape(BINS, BITS)
    return np.packbits(bits, axis=1)[:, 0] >> (8 - BITS)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard likeness of two texts' shingle sets.

    Low bits of different hashes agree by chance once in ``2 ** BITS``; the
    share of agreeing bins is corrected for that. Two texts without shingles
    are alike, one is unlike any other text.
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


class Fingerprinter:
    """Makes bin codes of texts, with a bounded cache of word hashes."""

    def __init__(self, shingle_words: int = SHINGLE_WORDS):
        self.hashes, self.size = WordHashes(), shingle_words

    def __call__(self, text: bytes | None) -> np.ndarray | None:
        return codes_of(shingle_hashes(self.hashes.of(lower_words(text)), self.size))


def add_fingerprint(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``fingerprint``, replacing a column of that name.

    Null, empty and blank texts get the empty string; texts of any length are read
    whole. Equal texts get equal fingerprints; so do texts that differ only in white
    space or A-Z case. Other columns, whatever their names, and repeated rows stay as
    they are; an empty table gives an empty one.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(shingle_words)
        for batch in batches:
            *kept, texts = batch.columns
            prints = pa.array([packed(make(t.as_py())) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, prints], names=names)

    rows = docs.drop("fingerprint")
    schema = T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType())])
    names = schema.names
    with_text = rows.withColumn(unused_name(rows, "own_text"), F.col(text_col).cast("binary"))
    return with_text.mapInArrow(per_batch, schema)


EDIT_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make, pending, out = Fingerprinter(), None, []

    def done(row: tuple, text: str, codes: np.ndarray | None) -> tuple:
        doc_id, own, own_codes = row
        cut = len(own) // 4
        edited = (own[: len(own) - cut] + text[:cut]).encode("utf-8", "surrogateescape")
        edited_codes = make(edited)
        digest = hashlib.sha256(edited).hexdigest()
        near = likeness(own_codes, edited_codes), likeness(own_codes, codes)
        return doc_id, len(own), digest, packed(own_codes), packed(edited_codes), *near

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*out)]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        names = [c.split()[0] for c in EDIT_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "_text", "_after")]
        for doc_id, text, after in zip(*columns):
            if after.as_py() and pending is None:
                continue
            raw = text.as_py() or b""
            codes, decoded = make(raw), raw.decode("utf-8", "surrogateescape")
            if pending is not None:
                out.append(done(pending, decoded, codes))
            pending = None if after.as_py() else (doc_id.as_py(), decoded, codes)
        if len(out) >= ROWS_OUT:
            yield flushed()
            out.clear()
    if out:
        yield flushed()


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text after an edit, and their likeness.

    The edit replaces the last quarter of the code points (rounded down) by the
    beginning of the next document in ascending ``doc_id``; the first follows
    the last. ``near_next`` is the likeness to the next document. A null text
    counts as empty. Null ids come last, equal ids in the order of their texts;
    repeated rows follow each other. A sole document is its own successor. An
    empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    return in_order(rows, "doc_id", "_text").drop("_key").mapInArrow(_edit_rows, EDIT_SCHEMA)
