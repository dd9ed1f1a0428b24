"""Language by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-case text are hashed. The model
is trained with follow-the-regularised-leader and an elastic-net penalty, which
leaves most weights at zero; its probabilities are then calibrated by one
temperature, chosen on rows that it did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.llm.columns import unused_name

BUCKETS = 1 << 14
#: About so many labelled rows of each language are learned from, drawn by a hash of the id.
ROWS_PER_LANG = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
#: Characters counted at once, to bound the memory a very long text takes.
BLOCK = 1 << 20
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)
_SPACE = np.uint64(32)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-case text; all below '@' and the other ASCII signs count as a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sign = (points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 160))
    return np.where(sign, _SPACE, points)


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text, as BUCKETS numbers."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    points = _codes(text)
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + 2]
        own = min(BLOCK, len(points) - at)
        value = np.zeros(len(part), dtype=np.uint64)
        for n in range(3):
            length = len(part) - n
            if length <= 0:
                break
            value = value[:length] * np.uint64(0x01000193) + part[n : n + length] * _MULTIPLIERS[n] + np.uint64(n)
            spread = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            total += np.bincount(spread[:own].astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode's letter classes; digits and numerals are none."""
    return bool(text) and any(map(str.isalpha, text))


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf
    return values / max(float(np.sqrt((values**2).sum())), 1e-12)


@dataclass
class Model:
    """Languages, inverse document frequencies, weights, biases and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        counts = ngram_counts(text)
        used = np.flatnonzero(counts)
        values = _weighted(counts[used], self.idf[used])
        chances = _softmax((values @ self.weights[used] + self.bias) / self.temperature)
        best = int(chances.argmax())
        return self.langs[best], float(chances[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, langs: list[str], seed: int = 3) -> Model:
    """FTRL-proximal over ``(buckets, counts, language)`` rows; a fifth calibrates the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    fitted, held = order[len(rows) // 5 :], order[: len(rows) // 5]
    size = len(langs)
    z, n = np.zeros((BUCKETS + 1, size)), np.zeros((BUCKETS + 1, size))
    ready = [(np.append(b, BUCKETS), np.append(_weighted(c, idf[b]), 1.0), k) for b, c, k in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            used, values, lang = ready[i]
            w = _proximal(z[used], n[used])
            off = _softmax(values @ w)
            off[lang] -= 1
            pull = values[:, None] * off[None, :]
            grown = n[used] + pull**2
            z[used] += pull - (np.sqrt(grown) - np.sqrt(n[used])) / ALPHA * w
            n[used] = grown
    w = _proximal(z, n)
    temperature = 1.0
    if len(held):
        logits = np.array([ready[i][1] @ w[ready[i][0]] for i in held])
        right = np.array([ready[i][2] for i in held])

        def loss(t: float) -> float:
            return -float(np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean())

        temperature = min(np.geomspace(0.05, 5, 80), key=loss)
    return Model(langs, idf, w[:BUCKETS], w[BUCKETS], float(temperature))


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from the text and ``lang`` of ``docs``; rows without either are left out.

    Document frequencies count all given documents, in the tasks, and one number
    per bucket and task is summed. The weights are learned on the driver from
    about ``rows_per_lang`` rows of each language, as bucket counts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += ngram_counts(text.as_py()) > 0
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(total)], names=["bucket", "n"])

    found = known.select("text").mapInArrow(frequencies, "bucket int, n bigint")
    df = np.zeros(BUCKETS)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        df[row["bucket"]] = row["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 0.1

    share = F.lit(None).cast("double")
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_lang / sizes[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, counts = [], []
            for text in batch.column(1):
                total = ngram_counts(text.as_py())
                used.append(np.flatnonzero(total).astype(np.int32))
                counts.append(total[used[-1]].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(used, kind), pa.array(counts, kind)], names=["lang", "buckets", "counts"]
            )

    # Rows that repeat fall on the same side of the draw, so each of them counts once.
    drawn = known.where(draw < share).distinct().select("lang", "text")
    table = drawn.mapInArrow(counted, "lang string, buckets array<int>, counts array<int>").toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    rows = [
        (np.asarray(b.values), np.asarray(c.values), place[k.as_py()])
        for k, b, c in zip(*[table.column(n) for n in ("lang", "buckets", "counts")])
    ]
    return train(rows, idf, langs)


def add_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, replacing columns of these names.

    Only the text is read, the whole of it however long. Null, empty and letterless
    texts are ``und`` with score 0. Other columns, whatever their names, and repeated
    rows stay as they are; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            *kept, texts = batch.columns
            found = [learnt.predict(t.as_py()) for t in texts]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=names)

    rows = docs.drop("lang_pred", "score")
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *made])
    names = schema.names
    return rows.withColumn(unused_name(rows, "own_text"), F.col(text_col)).mapInArrow(per_batch, schema)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose language is never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
