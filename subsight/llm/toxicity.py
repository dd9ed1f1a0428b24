"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-case words and their first four, five
and six bytes, hashed. Besides a weight, each term has a short vector, and a pair
of terms adds the product of their vectors; so an insult next to the mention of a
group can count for more than both alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.llm.columns import unused_name
from subsight.llm.words import CACHE_WORDS, lower_words
from subsight.sources.tables import materialize

PREFIXES = (4, 5, 6)
HASH_BITS = 22
#: About so many labelled rows are learned from; more are thinned by a hash of the id.
TRAIN_ROWS = 20_000
#: Terms in fewer training documents are not learned; of the others the most telling so many are.
MIN_DOCS = 3
#: How many standard deviations a term's toxic count must lie from what chance gives.
MIN_TELLING = 2.5
TERMS = 8_000
FACTORS = 8
EPOCHS = 15
BATCH = 256
RATE = 0.1
L2 = 1e-4
THRESHOLD = 0.7
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
_MASK = (1 << HASH_BITS) - 1


def term_ids(word: bytes) -> list[int]:
    """Hashed terms of one word: itself and its prefixes."""
    bare = word.strip(_EDGE)
    if not bare:
        return []
    terms = [b"w" + bare, *[b"p" + bare[:n] for n in PREFIXES if len(bare) >= n]]
    return list(dict.fromkeys(xxhash.xxh64_intdigest(t) & _MASK for t in terms))


class _Terms(dict):
    """Terms of words, each made once; ``known`` maps those to keep to their places."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = term_ids(word)
        if self.known is not None:
            ids = [self.known[i] for i in ids if i in self.known]
        value = self[word] = tuple(ids)
        return value

    def of(self, text: bytes | None) -> list[int]:
        found: set[int] = set()
        for word in set(lower_words(text)):
            ids = self[word]
            if ids:
                found.update(ids)
        return sorted(found)


@dataclass
class Model:
    """A learned machine: places of the terms, bias, weights and vectors."""

    known: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, places: list[int]) -> float:
        """Probability of the toxic label for a document with these terms."""
        total = self.bias
        if places:
            rows = self.vectors[places]
            total += self.weights[places].sum() + 0.5 * float((rows.sum(0) ** 2 - (rows**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def learn(docs: list[list[int]], labels: np.ndarray, known: dict[int, int], seed: int = 5) -> Model:
    """Fit by AdaGrad on small batches of the logistic loss, with a ridge on weights and vectors."""
    rng = np.random.default_rng(seed)
    count = max(1, len(known))
    w, v = np.zeros(count), rng.normal(0, 0.01, (count, FACTORS))
    share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(count, 1e-6), np.full((count, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            lengths = np.array([len(docs[i]) for i in batch])
            ids = np.array([j for i in batch for j in docs[i]], dtype=np.int64)
            row = np.repeat(np.arange(len(batch)), lengths)
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, row, v[ids])
            squares = np.bincount(row, (v[ids] ** 2).sum(1), len(batch))
            linear = np.bincount(row, w[ids], len(batch))
            total = bias + linear + 0.5 * ((sums**2).sum(1) - squares)
            off = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[batch]) / len(batch)
            gb += off.sum() ** 2
            bias -= RATE * off.sum() / np.sqrt(gb)
            touched, back = np.unique(ids, return_inverse=True)
            step = np.bincount(back, off[row], len(touched)) + L2 / len(batch) * w[touched]
            gw[touched] += step**2
            w[touched] -= RATE * step / np.sqrt(gw[touched])
            pulls = np.zeros((len(touched), FACTORS))
            np.add.at(pulls, back, off[row, None] * (sums[row] - v[ids]))
            pulls += L2 * v[touched]
            gv[touched] += pulls**2
            v[touched] -= RATE * pulls / np.sqrt(gv[touched])
    return Model(known, bias, w, v)


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(terms, toxic)`` of about ``rows`` labelled documents; rows that repeat count once."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("toxic")
    )
    share = min(1.0, rows / max(1, marked.count()))
    drawn = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    # About ``rows`` ids and labels at most, whatever the size of the tables.
    chosen = F.broadcast(marked.where(drawn).distinct())
    own = docs.select(F.col("doc_id").alias("_own"), F.col("text").cast("binary").alias("text"))
    texts = own.join(chosen, F.col("_own") == F.col("_id")).select("text", "toxic", "_id")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            found = pa.array([terms.of(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], names=["terms", "toxic", "_id"])

    kind = marked.schema["_id"].dataType.simpleString()
    found = texts.mapInArrow(per_batch, f"terms array<int>, toxic double, _id {kind}")
    return materialize(found.distinct().drop("_id"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled documents of ``docs``; about ``train_rows`` of them, drawn by a hash.

    Terms are counted and ranked by Spark. The driver gets ``TERMS`` terms and,
    for each drawn row, only which of these it has. Without labels the model
    scores every text alike.
    """
    drawn = _labelled(docs, labels, train_rows)
    sizes = drawn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("bad")).first()
    bad, good = sizes["bad"], sizes["n"] - sizes["bad"]
    counts = (
        drawn.select(F.explode("terms").alias("term"), "toxic")
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
        .where(F.col("n") >= MIN_DOCS)
    )
    expected = F.col("n") * F.lit(float(bad / max(1.0, sizes["n"])))
    telling = F.abs(F.col("bad") - expected) / F.sqrt(expected + F.lit(0.5))
    ranked = counts.withColumn("telling", telling).where(F.col("telling") >= MIN_TELLING)
    top = ranked.orderBy(F.col("telling").desc(), "term").limit(TERMS).select("term")
    known = {r["term"]: i for i, r in enumerate(sorted(top.collect()))} if bad and good else {}
    if not known:
        share = float(bad / sizes["n"]) if sizes["n"] else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, FACTORS)))
    rows = drawn.select(F.array_intersect("terms", F.lit(list(known))).alias("terms"), "toxic").toArrow()
    features = [sorted(known[t] for t in terms) for terms in rows.column("terms").to_pylist()]
    return learn(features, rows.column("toxic").to_numpy(), known)


def add_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), replacing a column of that name.

    Only the text is read, the whole of it however long. Null and empty texts get the
    score of a text without known terms. Other columns, whatever their names, and
    repeated rows stay as they are; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by TERMS

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        terms = _Terms(learnt.known)
        for batch in batches:
            *kept, texts = batch.columns
            scores = pa.array([learnt.score(terms.of(t.as_py())) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, scores], names=names)

    rows = docs.drop("score")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.names
    with_text = rows.withColumn(unused_name(rows, "own_text"), F.col(text_col).cast("binary"))
    return with_text.mapInArrow(per_batch, schema)


def is_held_out(doc_id: str = "doc_id"):
    """Documents whose labels are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_open(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the documents that are not held out."""
    return fit(docs.where(~is_held_out()), labels.where(~is_held_out()), train_rows)
