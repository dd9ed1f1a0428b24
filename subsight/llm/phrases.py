"""Phrase collocations from an FM-index per shard.

Each shard of the corpus writes a bidirectional FM-index of its words. Levels of longer
phrases are enumerated from it by extending intervals to the right and to the left;
counts are summed across shards, and only phrases whose parts are frequent in the whole
corpus are extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subsight.llm.fm_index import DEPTH, FMIndex, Phrases, index
from subsight.llm.words import LOWER, mixed
from subsight.sources.tables import materialize, shared_dir

MIN_COUNT = 30
#: A phrase goes if a longer one has at least this many percent of its count.
INSIDE_PERCENT = 80
SCORE_SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"
#: A shard is closed beyond so many words (a single piece is never split).
SHARD_WORDS = 1 << 20
#: Rows of one file, as a task holds those of a file at once.
SHARDS_PER_FILE = 2
#: Rows that one task counts one after the other, so that fewer counts have to move; small corpora use all cores first.
SHARDS_PER_TASK = 16
#: Occurrences that are extended at once.
BLOCK = 1 << 18
#: Bits of the filter of frequent phrases. Full or not, it never hides a frequent one: it only saves work.
FILTER_BITS = 1 << 26
_BLOCK_BYTES = 1 << 14
#: Rows a task hands on at once.
ROWS = 1 << 17
#: The last ranking takes the first rows of so many parts of a language.
PARTS = 256

_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
#: A-Z in lower case, a tab as a blank, and every sign that ends a piece as a line end.
_PREPARED = bytes(10 if b in _BREAKS else 32 if b == 9 else LOWER[b] for b in range(256))
_SHARD = "lang string, words binary, backward binary, forward binary"
_COUNTED = "lang string, phrase string, f long"


class _Numbers(dict):
    """Numbers of words from 1 in the order they come; 0 is the end of a piece, -1 no word."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number


class _Shard:
    """The words of one language in a shard as numbers; a 0 stands around each piece."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.pieces: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        """Number the words of a text; returns how many places they take."""
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        words = text.translate(_PREPARED).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words))
        ids = np.append(ids[ids >= 0], np.int32(0))
        self.pieces.append(ids)
        return len(ids)

    def row(self, lang: str) -> dict:
        sequence = np.concatenate([np.zeros(1, dtype=np.int32), *self.pieces])
        backward, forward = index(sequence)
        return {
            "lang": lang,
            "words": b" ".join(list(self.numbers)[2:]),
            "backward": backward.astype("<i4").tobytes(),
            "forward": forward.astype("<i4").tobytes(),
        }


def shards_of(docs: DataFrame) -> DataFrame:
    """An FM-index for each shard and language, one row each."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            for lang, shard in open_.items():
                if len(shard.numbers) > 2:
                    yield pa.RecordBatch.from_pylist([shard.row(lang)], schema)

        schema = pa.schema([("lang", pa.string()), *[(n, pa.binary()) for n in ("words", "backward", "forward")]])
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                size += open_.setdefault(lang.as_py(), _Shard()).add(text.as_py() or b"")
                if size >= SHARD_WORDS:
                    yield from closed()
                    open_, size = {}, 0
        yield from closed()

    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary"))
    return named.mapInArrow(built, _SHARD)


def phrase_hashes(words: np.ndarray, lang: str) -> np.ndarray:
    """A 64-bit hash per row of word hashes."""
    total = np.full(len(words), xxhash.xxh64_intdigest(lang.encode()), dtype=np.uint64)
    for i in range(words.shape[1]):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return total


@dataclass(frozen=True)
class Filter:
    """Which phrases may be frequent: a bit per hash, and no bit of a frequent one is missing."""

    bits: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(frequent: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """Gather the bits of hashes ``h``: at most ``bits / 8`` bytes, however many there are."""
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    marks = frequent.select(
        F.shiftright(place, 6).alias("place"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}) % 64 AS int))").alias("mark")
    )
    places = marks.groupBy("place").agg(F.bit_or("mark").alias("mark"))
    size = _BLOCK_BYTES // 8

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        block = np.zeros(size, dtype=np.int64)
        block[rows["place"].to_numpy() % size] = rows["mark"].to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([block.tobytes()], pa.binary())})

    blocks = places.withColumn("block", F.expr(f"place div {size}")).groupBy("block")
    found = np.zeros(max(bits // 8, _BLOCK_BYTES), dtype=np.uint8)
    for row in blocks.applyInArrow(joined, "block long, bytes binary").collect():
        found[row["block"] * _BLOCK_BYTES :][:_BLOCK_BYTES] = np.frombuffer(row["bytes"], dtype=np.uint8)
    return Filter(found[: bits // 8])


def _hashed(words: DataFrame) -> DataFrame:
    """The hashes ``h`` of single words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, own = batch.column(0), np.array([xxhash.xxh64_intdigest(w) for w in batch.column(1).to_pylist()], dtype=np.uint64)
            for lang in pc.unique(langs).to_pylist():
                here = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([_longs(phrase_hashes(own[here][:, None], lang))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(hashed, "h long")


def _longs(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, FMIndex]]:
    """Language, words (from 1) and index of each shard."""
    for batch in batches:
        for lang, listed, *transforms in zip(*batch.columns):
            words = pa.array(["", *listed.as_py().decode().split(" ")], pa.string())
            yield lang.as_py(), words, FMIndex(*[np.frombuffer(x.as_buffer(), dtype="<i4") for x in transforms])


class _Grown:
    """The phrases of a shard that may be frequent, level by level."""

    def __init__(self, lang: str, words: pa.Array, fm: FMIndex, singles: Filter):
        self.lang, self.fm = lang, fm
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)
        self.frequent = singles.holds(phrase_hashes(self.hashes[:, None], lang))

    def hashes_of(self, words: np.ndarray) -> np.ndarray:
        return phrase_hashes(self.hashes[words], self.lang)

    def pairs(self) -> Iterator[Phrases]:
        """Pairs of words that may both be frequent, in blocks: words extended to the right."""
        level = self.fm.words()
        level = level.where(self.frequent[level.words[:, 0]])
        cuts = np.flatnonzero(np.diff(np.cumsum(level.counts) // BLOCK, prepend=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(level)]):
            block = self.fm.extend(level.where(slice(start, end)), "right")
            yield block.where(self.frequent[block.words[:, 1]])

    def levels(self, pairs: Filter, deepest: int) -> Iterator[Phrases]:
        """Phrases all of whose pairs may be frequent: pairs grow to the left, triples to the right."""
        for level in self.pairs():
            level = level.where(pairs.holds(self.hashes_of(level.words)))
            yield level
            for depth in range(3, deepest + 1):
                side, at = ("left", 0) if depth % 2 else ("right", depth - 2)
                level = self.fm.extend(level, side)
                level = level.where(self.frequent[level.words[:, at if side == "left" else -1]])
                level = level.where(pairs.holds(self.hashes_of(level.words[:, at : at + 2])))
                yield level


def _texts(words: pa.Array, phrases: np.ndarray) -> pa.Array:
    parts = [words.take(pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
    return pc.binary_join_element_wise(*parts, " ")


def _rows(lang: str, words: pa.Array, level: Phrases) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(level), ROWS):
        part = level.where(slice(at, at + ROWS))
        columns = [pa.array([lang] * len(part), pa.string()), _texts(words, part.words), pa.array(part.counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])


def _count_words(shards: DataFrame) -> DataFrame:
    """All words with their counts, summed across shards; ``lang, phrase, f``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, fm in _read(batches):
            yield from _rows(lang, words, fm.words())

    rows = shards.drop("forward").mapInArrow(counted, _COUNTED)
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _count_pairs(shards: DataFrame, singles: Broadcast) -> DataFrame:
    """Pairs of frequent words with their counts, summed across shards, by hash; ``h, f``.

    Where hashes fall together a pair counts too much: it is counted anew by its text later.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, fm in _read(batches):
            grown = _Grown(lang, words, fm, singles.value)
            for level in grown.pairs():
                hashes = _longs(grown.hashes_of(level.words))
                yield pa.RecordBatch.from_arrays([hashes, pa.array(level.counts, pa.int64())], names=["h", "f"])

    rows = shards.drop("forward").mapInArrow(counted, "h long, f long")
    return rows.groupBy("h").agg(F.sum("f").alias("f"))


def _count_phrases(shards: DataFrame, singles: Broadcast, pairs: Broadcast, deepest: int) -> DataFrame:
    """Phrases of two words and more whose pairs may be frequent, summed across shards; ``lang, phrase, f``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, fm in _read(batches):
            for level in _Grown(lang, words, fm, singles.value).levels(pairs.value, deepest):
                yield from _rows(lang, words, level)

    return shards.mapInArrow(counted, _COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, deepest: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``deepest`` words with at least ``min_count`` occurrences, and the words of each language.

    Returns ``lang, phrase, f, size`` and ``lang, n``, both over written tables. A phrase
    is counted by its text only if the words in it, and the pairs of neighbours in it, may
    be frequent in the whole corpus; that is known from one pass each.
    """
    context = docs.sparkSession.sparkContext
    path = shared_dir(docs.sparkSession)
    shards_of(docs).write.option("maxRecordsPerFile", SHARDS_PER_FILE).option("compression", "zstd").parquet(path)
    shards = docs.sparkSession.read.schema(_SHARD).parquet(path)
    shards = shards.coalesce(max(4 * context.defaultParallelism, shards.count() // SHARDS_PER_TASK))
    words = materialize(_count_words(shards))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    many = F.col("f") >= min_count
    singles = context.broadcast(filter_of(_hashed(words.where(many))))
    pairs = context.broadcast(filter_of(_count_pairs(shards, singles).where(many)))
    longer = _count_phrases(shards, singles, pairs, deepest).where(many)
    everything = words.where(many).unionByName(longer)
    return materialize(everything.withColumn("size", F.size(F.split("phrase", " ")))), totals


def _exact(column: Column | str) -> Column:
    """A count as a decimal: products of counts may pass 64 bits."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases of two to four words by the tie between their parts.

    Columns ``lang, rank, phrase, a, l, r, n, score``. ``a``, ``l``, ``r`` count the phrase,
    the part before and the part after its weakest cut, ``n`` all words of the
    language; score is ``floor(2000000 * a / (l + r))``. A phrase that mostly occurs
    inside a longer one is left out. It is enough to look at phrases longer by one
    word: where a still longer one has so large a share, so has one of those inside it.

    Counting is exact and over whole texts. A null text is empty, a null language is
    ``und``; ties go by count, then by the bytes of the phrase; rows that repeat count each
    time. Columns other than ``text`` and ``lang`` are left aside; bytes that are not UTF-8
    become U+FFFD; an empty table, or one
    without frequent phrases, gives no rows.
    """
    known, totals = frequent_phrases(docs, min_count)
    many = known.where(F.col("size") > 1).withColumnRenamed("f", "a")
    part = known.select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("_left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "_right", F.expr("substring_index(phrase, ' ', k - size)")
    )
    lefts = part.select("lang", F.col("_part").alias("_left"), F.col("_f").alias("l"))
    rights = part.select("lang", F.col("_part").alias("_right"), F.col("_f").alias("r"))
    scored = (
        cut.join(lefts, ["lang", "_left"])
        .join(rights, ["lang", "_right"])
        .withColumn("score", F.expr(f"({SCORE_SCALE} * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + r)"))
    )
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    longer = many.where(F.col("size") > 2).select("lang", F.col("a").alias("_longer"), F.explode(_inner()).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    inside = _exact("_longer") * 100 >= _exact("a") * INSIDE_PERCENT
    free = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | ~inside)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = free.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score").withColumn(
        "_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    )
    some = W.partitionBy("lang", "_part").orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inner() -> Column:
    """A phrase without its last and without its first word."""
    return F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
