"""Packing of tokenized documents into sequences of bounded length.

Documents are tokenized and cut into pieces in one pass. What the planning needs of
them is the histogram of their lengths, at most as many numbers as a sequence has
places. Over it a linear program of configurations (sets of lengths that fit in a
sequence) is solved by multiplicative weights: lengths that the configurations chosen
so far cover least cost most, and a knapsack by dynamic programming finds the
configurations worth most. The solution is rounded down, best fit packs what is left,
and the pieces are dealt to the places of their length by their rank.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.sources.tables import materialize

CAPACITY = 2048
#: The token after each document.
END = 0
#: The largest share of a length's pieces that one round of the multiplicative weights covers.
LEAST_STEP = 1 / 8
#: How strongly a covered length falls in price, the step, and the rounds; each is tried until the result is near the bound.
SETTINGS = ((0.1, 1 / 8, 150), (3.0, 1 / 32, 300), (12.0, 1 / 128, 600))
NEAR = 0.002
#: Configurations this much below the best one in price are taken too.
SLACK = 0.05
#: Pieces of a length that are ranked together: at least so many, and at least the root of all.
LEAST_PART = 200
#: Byte-level vocabularies of this kind split a text so before they merge (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE vocabulary of a tokenizer file, ready to encode.

    Gives the ids that the file's own library gives without added special tokens,
    some five times as fast.
    """
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    if stored["model"]["type"] != "BPE" or stored["pre_tokenizer"]["type"] != "ByteLevel" or stored["normalizer"]:
        raise ValueError(f"{path} holds no plain byte-level BPE")
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in stored["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, allowed_special="all")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, len(ids), capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize all documents once and cut them; ``doc_id, piece, start, length, ids_crc32``."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, text in enumerate(batch.column(1)):
                found = token_ids(path, (text.as_py() or b"").decode("utf-8", "replace"))
                ids = np.append(found, END).astype("<u4")
                rows += [
                    (place, i, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for i, (start, length) in enumerate(cut(ids, capacity))
                ]
            place, piece, start, length, crc = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                names=schema.names,
            )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(tokenized, schema)


def _priced(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming over the capacity.

    ``prices[l]`` is what a piece of length ``l`` is worth. Returns the best worth for
    each capacity, and the piece to take first (0: leave a place empty). Of pieces worth
    the same the longest is taken: short ones fit anywhere later.
    """
    capacity = len(prices) - 1
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        worth = prices[room:0:-1] + best[:room]
        i = int(worth.argmax())
        if worth[i] > best[room - 1]:
            best[room], first[room] = worth[i], room - i
        else:
            best[room] = best[room - 1]
    return best, first


def _filled(first: np.ndarray, room: int) -> list[int]:
    lengths = []
    while room:
        if length := int(first[room]):
            lengths.append(length)
        room -= max(length, 1)
    return lengths


def _counted(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    """A configuration: its lengths, falling, with their numbers."""
    kinds, numbers = np.unique(lengths, return_counts=True)
    return tuple((int(k), int(n)) for k, n in zip(kinds[::-1], numbers[::-1]))


def fractional(counts: np.ndarray) -> tuple[dict[tuple, float], float]:
    """Solve the linear program of configurations over a histogram; ``counts[l]`` pieces have length ``l``.

    Returns how often each configuration is taken, and a lower bound of the number of
    sequences. Weights that move little are tried first, as sizes are near the best
    prices where many lengths are to be had; then ever stronger ones with smaller
    steps, until the solution comes near the bound.
    """
    sizes = np.arange(len(counts)) / (len(counts) - 1)
    best, least, bound = {}, np.inf, float(counts @ sizes)
    for rate, step, rounds in SETTINGS:
        taken, found = _covered(counts, rate, step, rounds)
        bound = max(bound, found)
        held = np.zeros(len(counts))
        for config, often in taken.items():
            for kind, number in config:
                held[kind] += often * number
        needed = sum(taken.values()) + float((counts - held) @ sizes)
        if needed < least:
            best, least = taken, needed
        if least <= bound * (1 + NEAR):
            break
    return best, bound


def _covered(counts: np.ndarray, rate: float, step: float, rounds: int) -> tuple[dict[tuple, float], float]:
    """Cover the lengths by multiplicative weights.

    A length is worth its size, times a factor that falls exponentially with the share
    of its pieces that is covered. Each round prices configurations by a knapsack and
    takes those of nearly the best worth, so far that no length is covered by more
    than one step. Prices at which no configuration is worth more than 1 make all
    pieces together worth no more than any packing has sequences: a lower bound.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1) / capacity
    # A length with fewer pieces than steps would be rounded away: best fit places it.
    demand = np.where(counts * max(step, LEAST_STEP) >= 1, counts, 0).astype(float)
    covered = np.where(demand > 0, 0.0, np.inf)
    taken: dict[tuple, float] = {}
    bound = 0.0
    for _ in range(rounds):
        open_ = covered < 1
        if not open_.any():
            break
        weights = sizes * np.exp(-rate * (np.where(demand > 0, covered, 0) - covered.min()))
        best, first = _priced(np.where(open_, weights, 0.0))
        if open_[demand > 0].all():
            bound = max(bound, float(demand @ weights) / best[-1])
        prices = np.where(open_, weights, 0.0)
        left = np.where(open_, np.minimum(step, 1 - np.where(open_, covered, 1)) * demand, 0.0)
        for length in [0, *np.flatnonzero(open_)[::-1]]:
            if length and (left[length] <= 0 or prices[length] + best[capacity - length] < (1 - SLACK) * best[-1]):
                continue
            config = _counted([length] * bool(length) + _filled(first, capacity - length))
            often = min(left[kind] / number for kind, number in config)
            if often <= 0:
                continue
            taken[config] = taken.get(config, 0.0) + often
            for kind, number in config:
                left[kind] -= often * number
                covered[kind] += often * number / demand[kind]
    return taken, bound


def _best_fit(counts: np.ndarray) -> dict[tuple, int]:
    """Best fit by falling length: each piece goes to the fullest sequence that has room for it."""
    capacity = len(counts) - 1
    open_: dict[int, list[list[int]]] = {}
    rooms = 0  # a bit for each room that some sequence has
    for length in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[length])):
            fitting = rooms >> length
            room = length + (fitting & -fitting).bit_length() - 1 if fitting else capacity
            same = open_.get(room)
            held = same.pop() if same else []
            if same is not None and not same:
                del open_[room]
                rooms &= ~(1 << room)
            held.append(length)
            open_.setdefault(room - length, []).append(held)
            rooms |= 1 << room - length
    packed: dict[tuple, int] = {}
    for same in open_.values():
        for held in same:
            config = _counted(held)
            packed[config] = packed.get(config, 0) + 1
    return packed


@dataclass(frozen=True)
class Plan:
    """For the pieces of each length, in the order of their rank, the places they get.

    The ``i``-th run of a length begins at rank ``ranks[i]``; its sequences count from
    ``sequences[i]`` and hold ``numbers[i]`` pieces of that length each, from ``offsets[i]``.
    """

    ranks: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    total: int
    bound: float

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of one length with the given ranks."""
        run = np.searchsorted(self.ranks[length], rank, side="right") - 1
        inside = rank - self.ranks[length][run]
        number = self.numbers[length][run]
        return self.sequences[length][run] + inside // number, self.offsets[length][run] + inside % number * length


def plan(counts: np.ndarray) -> Plan:
    """Configurations for a histogram of lengths, rounded to whole sequences that hold every piece once.

    The work and the result depend on the number of lengths, not on that of the pieces,
    but for what rounding leaves: below one sequence for each configuration, and
    lengths with few pieces.
    """
    left = counts.astype(np.int64).copy()
    chosen: dict[tuple, int] = {}
    full = int(left[-1])
    if full:  # they fill a sequence on their own
        chosen[((len(counts) - 1, 1),)] = full
        left[-1] = 0
    taken, bound = fractional(left)
    # The fullest first, as what is left over goes to best fit.
    for config in sorted(taken, key=lambda c: (-sum(k * n for k, n in c), -taken[c], c)):
        often = min(math.floor(taken[config] + 1e-9), *(int(left[k]) // n for k, n in config))
        if often:
            chosen[config] = chosen.get(config, 0) + often
            for kind, number in config:
                left[kind] -= often * number
    for config, often in _best_fit(left).items():
        chosen[config] = chosen.get(config, 0) + often
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, often in chosen.items():
        offset = 0
        for kind, number in config:
            runs.setdefault(kind, []).append((ranks.get(kind, 0), sequence, number, offset))
            ranks[kind] = ranks.get(kind, 0) + often * number
            offset += kind * number
        sequence += often
    parts = [{k: np.array([r[i] for r in rows], dtype=np.int64) for k, rows in runs.items()} for i in range(4)]
    return Plan(*parts, sequence, bound + full)


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Number the pieces of each length from 0 as ``rank``; a common length is split over many tasks."""
    spark: SparkSession = pieces.sparkSession
    size = max(LEAST_PART, math.isqrt(sum(histogram.values())))
    parts = [(length, number // size + 1) for length, number in histogram.items()]
    # At most ``capacity`` rows.
    known = F.broadcast(spark.createDataFrame(parts, "length long, _parts long"))
    order = ["doc_id", "piece", "ids_crc32"]
    dealt = pieces.join(known, "length").withColumn("_part", F.pmod(F.xxhash64(*order), "_parts")).drop("_parts")
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "_part")
        .agg(F.count("*").alias("_n"))
        .select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("length", "_part").orderBy(*order)
    return (
        dealt.withColumn("_in", F.row_number().over(inside))
        .join(starts, ["length", "_part"])
        .withColumn("rank", F.col("_start") + F.col("_in") - 1)
        .drop("_in", "_start", "_part")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A document is its ids and the id 0 at the end; only longer ones are cut.
    ``path`` names a byte-level BPE file that all executors see at the same place.

    A null or empty text is the id 0 alone; a text of any length is cut into pieces.
    Rows that repeat or lack a ``doc_id`` are packed row by row; rows alike in id and text
    may swap places, which does not change the result. Columns other than ``doc_id``
    and ``text`` are left aside, whatever their names; an empty table gives an empty one.
    Bytes that are not UTF-8 become U+FFFD.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = materialize(pieces_of(docs, path, capacity))
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, number in histogram.items():
        counts[length] = number
    found = plan(counts)
    known = pieces.sparkSession.sparkContext.broadcast(found)
    names = pieces.columns
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            for length in np.unique(lengths).tolist():
                here = lengths == length
                sequence[here], offset[here] = known.value.place(length, ranks[here])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=schema.names
            )

    return _ranked(pieces, histogram).select(*names, "rank").mapInArrow(placed, schema)
