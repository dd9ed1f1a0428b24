"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages about as long as the benchmark items. A
passage is a TF-IDF vector over hashed words, brought into few dimensions by a
randomised singular value decomposition that Spark computes over all texts. Passages near an
item by cosine are candidates; a longest common subsequence of words, and of the
item's answer (its end), decides. Words are kept as 32-bit hashes; the vectors
take the low bits of these, the subsequences compare them whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.llm.lcs import lcs_length, masks_of
from subsight.llm.words import LOWER, mixed
from subsight.sources.tables import materialize

#: Columns of the vectors.
TERMS = 1 << 15
#: Bytes of a word's hash.
WORD_BYTES = 4
RANK = 64
OVERSAMPLE = 8
POWER_ROUNDS = 2
#: Directions with a smaller part of the largest eigenvalue are taken as absent.
FLAT = 1e-5
#: An item counts in the fit as this part of all passages do, so that a large corpus does not hide in what items differ.
ITEM_PART = 1 / 4000
#: Part of the largest eigenvalue that is added before a matrix is inverted.
SHIFT = 1e-7
#: Words and passages that a fitting task looks at together; 16 bits tell the passages apart.
FIT_WORDS = 1 << 18
FIT_ROWS = 1 << 13
#: Terms in fewer passages among these are added side by side, others one by one.
FEW = 32
MIN_COSINE = 0.55
MIN_SHARE = 0.6
MIN_ANSWER = 0.6
#: The answer is the last part of an item: one third of its words.
ANSWER_PART = 3
#: Items compared in one pass over the corpus, and the bytes of their hashes; more take more passes.
ITEMS_PER_PASS = 20_000
ITEM_BYTES_PER_PASS = 1 << 26
#: Cosines computed at once.
PRODUCT_CELLS = 1 << 19
SMALLEST = 8
TEXTS_AT_ONCE = 32
#: Words brought into the latent space at once, a power of two, so that their vectors stay in a core's cache.
STRETCH = 1 << 13
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
BLOCKS = 64


class _WordIds:
    """32-bit hashes of words, A-Z in lower case and without the signs around them; signs alone are no words."""

    #: Bytes hashed at once.
    AT_ONCE = 1 << 19
    _KIND = np.array([0 if b in b" \t\n\v\f\r" else 1 if b in _EDGE else 2 for b in range(256)], dtype=np.uint8)
    _VALUE = mixed(np.frombuffer(LOWER, dtype=np.uint8).astype(np.uint64) + np.uint64(1))
    _BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers of an odd number and of its inverse, of 64 bits."""
        if n > len(self.up):
            self.up, self.down = (np.full(n, k, dtype=np.uint64) for k in (self._BASE, pow(self._BASE, -1, 1 << 64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
        return self.up[:n], self.down[:n]

    def of(self, text: bytes | None) -> np.ndarray:
        return self._of([text or b""])[0]

    def of_all(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            some.append(text or b"")
            size += len(some[-1]) + 1
            if size >= self.AT_ONCE:
                yield from self._of(some)
                some, size = [], 0
        yield from self._of(some)

    def _of(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        kind = self._KIND[raw]
        at = np.flatnonzero(kind == 2)
        word = np.cumsum(kind == 0, dtype=np.int32)[at]
        new = word[1:] != word[:-1]
        begins = at[np.append(len(at) > 0, new)] if len(at) else at
        ends = at[np.append(new, True)] if len(at) else at
        # A word's hash is the polynomial of its bytes: a difference of running sums, shifted to the word's begin.
        up, down = self._powers(len(raw))
        sums = np.cumsum(self._VALUE[raw] * up)
        hashed = (sums[ends] - sums[begins] + self._VALUE[raw[begins]] * up[begins]) * down[begins]
        found = (mixed(hashed) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cuts = np.cumsum([len(text) + 1 for text in texts[:-1]], dtype=np.int64)
        return np.split(found, np.searchsorted(begins, cuts)) if texts else []


def passage_size(words: int) -> int:
    """Passages for an item of so many words: the next power of two."""
    return max(SMALLEST, 1 << max(0, words - 1).bit_length())


def term_table(rows: DataFrame, name: str) -> DataFrame:
    """``(name, terms)``: the hashes of each text's words; written, as several passes read it."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _WordIds()
        for batch in batches:
            found = pa.array([found.tobytes() for found in terms.of_all(batch.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[name, "terms"])

    texts = rows.select(F.col(name).cast("long"), F.col("text").cast("binary"))
    return materialize(texts.mapInArrow(per_batch, f"`{name}` bigint, terms binary"))


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")


def _terms(raw: bytes) -> np.ndarray:
    """The columns of the words."""
    return (_words(raw) & np.uint32(TERMS - 1)).astype(np.intp)


def document_frequencies(table: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many texts each term occurs, over all texts; the numbers of texts and of words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 2, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total[_terms(raw)] += 1  # a term that repeats is set again, not added
                total[TERMS + 1] += len(raw) // WORD_BYTES
            total[TERMS] += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(TERMS + 2), pa.int32()), pa.array(total)], names=["term", "n"])

    found = table.select("terms").mapInArrow(counted, "term int, n bigint")
    total = np.zeros(TERMS + 2, dtype=np.int64)
    for row in found.where("n > 0").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS + 2 rows at most
        total[row["term"]] = row["n"]
    return total[:TERMS], int(total[TERMS]), int(total[TERMS + 1])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Whole texts of about FIT_WORDS words together, with their weights."""
    raws, weights = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float32)
    upto = np.cumsum([len(raw) for raw in raws]) // (WORD_BYTES * FIT_WORDS)
    ends = [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(raws)]
    for begin, end in zip([0, *ends], ends):
        if begin < end:
            yield raws[begin:end], weights[begin:end]


def _passages(raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of all words, a passage a row, and how many rows each text has.

    Passages do not overlap, and the last of a text is filled up with TERMS.
    """
    n = np.array([len(raw) // WORD_BYTES for raw in raws])
    rows = -(-n // size)
    ahead = np.repeat((np.cumsum(rows) - rows) * size - (np.cumsum(n) - n), n)
    filled = np.full(int(rows.sum()) * size, TERMS, dtype=np.uint32)
    filled[ahead + np.arange(len(ahead))] = _words(b"".join(raws)) & np.uint32(TERMS - 1)
    return filled.reshape(-1, size), rows


def add_product(total: np.ndarray, rows: np.ndarray, parts: np.ndarray, weighted: np.ndarray, weight: np.ndarray) -> None:
    """Add C'DCB to ``total``: C counts the words of the passages, D holds their weights over the squared norms of their vectors.

    ``parts`` are the weights of the passages and ``weighted`` is B; ``weight`` weighs the
    terms for the norms. The last two end with zeros for TERMS.
    """
    size, ones = rows.shape[1], np.ones((1, rows.shape[1]), dtype=np.float32)
    for begin in range(0, len(rows), FIT_ROWS):
        some = rows[begin : begin + FIT_ROWS]
        pairs = np.sort(((some << np.uint32(16)) | np.arange(len(some), dtype=np.uint32)[:, None]).ravel())
        pairs = pairs[: np.searchsorted(pairs, np.uint32(TERMS << 16))]
        if not len(pairs):
            continue
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        often = np.diff(np.append(first, len(pairs))).astype(np.float32)
        term, passage = (pairs[first] >> np.uint32(16)).astype(np.intp), (pairs[first] & np.uint32(0xFFFF)).astype(np.intp)
        norms = np.bincount(passage, (often * weight[term]) ** 2, len(some))
        at_once = max(1, STRETCH // size)
        products = np.empty((len(some), weighted.shape[1]), dtype=np.float32)
        for i in range(0, len(some), at_once):
            part = some[i : i + at_once]
            products[i : i + at_once] = np.matmul(ones, weighted.take(part.ravel(), axis=0).reshape(len(part), size, -1))[:, 0]
        products *= (parts[begin : begin + FIT_ROWS] / np.maximum(norms, 1e-18)).astype(np.float32)[:, None]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        ends = np.append(starts[1:], len(term))
        own, many = term[starts], ends - starts >= FEW
        for t, i, j in zip(own[many].tolist(), starts[many].tolist(), ends[many].tolist()):
            total[t] += often[i:j] @ products.take(passage[i:j], axis=0)
        own, starts, ends = own[~many], starts[~many], ends[~many]
        while len(own):
            total[own] += often[starts, None] * products.take(passage[starts], axis=0)
            left = starts + 1 < ends
            own, starts, ends = own[left], starts[left] + 1, ends[left]


def randomised_svd(texts: DataFrame, idf: np.ndarray, size: int, seed: int = 17) -> np.ndarray:
    """The leading right singular vectors of the normalised TF-IDF matrix A of all passages, over their singular values.

    TERMS x RANK. Dividing makes all latent directions count alike; otherwise the
    language of a passage would outweigh what it says. ``texts`` are rows ``(terms, weight)``; each
    is cut into passages of ``size`` words, the last one shorter, and each passage is a row
    of A as often as its weight says.

    Each round multiplies a thin matrix by A and by its transpose: tasks do this
    for their texts, blocks of terms are summed by Spark, and the driver only
    makes the columns orthogonal again.
    """
    spark, width = texts.sparkSession, RANK + OVERSAMPLE
    product = np.random.default_rng(seed).standard_normal((TERMS, width)).astype(np.float32)
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product)[0].astype(np.float32)
        shared = spark.sparkContext.broadcast((basis, idf))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, weight = shared.value
            padded, total = np.append(weight, np.float32(0)), np.zeros_like(q)
            weighted = np.vstack([q, q[:1]]) * padded[:, None]
            for batch in batches:
                for raws, own in _slices(batch):
                    rows, n = _passages(raws, size)
                    add_product(total, rows, np.repeat(own, n), weighted, padded)
            parts = [p.tobytes() for p in np.split(total * weight[:, None], BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

        def summed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(p, dtype=np.float32) for p in group["part"]], axis=0, dtype=np.float32)
            return pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

        parts = texts.select("terms", "weight").mapInArrow(partial, "block int, part binary").groupBy("block").applyInPandas(summed, "block int, part binary")
        blocks = {r["block"]: r["part"] for r in parts.collect()}  # BLOCKS rows
        shared.destroy()
        if not blocks:
            return np.zeros((TERMS, RANK), dtype=np.float32)
        product = np.concatenate([np.frombuffer(blocks[i], dtype=np.float32) for i in range(BLOCKS)]).reshape(TERMS, width)
    return nystrom(basis, product)


def nystrom(basis: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The leading eigenvectors of a matrix, over the roots of their eigenvalues, from its product with a basis.

    Nystrom's method: the last product serves for the directions too, so two passes tell what took three.
    """
    width = basis.shape[1]
    inner, gram = np.zeros((width, width)), np.zeros((width, width))
    shift = SHIFT * max(float(np.linalg.norm(product)), 1e-9)
    shifted = product + np.float32(shift) * basis
    for q, y in zip(np.split(basis, BLOCKS), np.split(shifted, BLOCKS)):
        wide = y.astype(np.float64)
        inner += q.astype(np.float64).T @ wide
        gram += wide.T @ wide
    # Directions that are rounding errors are left out before the inner matrix is inverted.
    known, turn = np.linalg.eigh((inner + inner.T) / 2)
    sound = known > shift / 2
    half = turn[:, sound] / np.sqrt(known[sound])
    values, vectors = np.linalg.eigh(half.T @ gram @ half)
    leading = np.argsort(-values)[:RANK]
    vectors, values = half @ vectors[:, leading], values[leading]
    # Where the rows have fewer directions than RANK, the others count nothing.
    own = np.maximum(values - shift, 0)
    real = own > FLAT * max(float(own.max(initial=0)), 1e-9)
    strength = np.where(real, np.sqrt(np.where(real, values * own, 1.0)), np.inf)
    space = np.zeros((TERMS, RANK), dtype=np.float32)
    space[:, : len(leading)] = shifted @ (vectors / strength).astype(np.float32)
    return space


@dataclass
class Item:
    """One benchmark item, ready for the word checks."""

    item_id: int
    masks: dict[int, int]
    counts: dict[int, int]
    length: int
    answer_masks: dict[int, int]
    answer_length: int

    @classmethod
    def of(cls, item_id: int, terms: list[int]) -> Item:
        answer = terms[-max(1, len(terms) // ANSWER_PART) :]
        return cls(item_id, masks_of(terms), Counter(terms), len(terms), masks_of(answer), len(answer))

    def shares(self, region: list[int], distinct: set[int]) -> tuple[float, float] | None:
        """Parts of the item and of its answer that the region has in order; None if either is too small."""
        # The item's places whose word the region has at all bound the subsequence.
        met = sum(map(self.counts.__getitem__, distinct & self.counts.keys()))
        if met < MIN_SHARE * self.length:
            return None
        share = lcs_length(region, self.masks, self.length) / self.length
        if share < MIN_SHARE:
            return None
        answer = lcs_length(region, self.answer_masks, self.answer_length) / self.answer_length
        return (share, answer) if answer >= MIN_ANSWER else None


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-9)


class Searcher:
    """Finds items in texts; holds the term vectors and one pass's items by passage size."""

    def __init__(self, space: np.ndarray, items: list[tuple[int, bytes]]):
        self.space = np.vstack([space, np.zeros((1, RANK), dtype=space.dtype)])  # the last row fills up blocks
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, raw in items:
            words = _words(raw)
            if len(words):
                by_size.setdefault(passage_size(len(words)), []).append((item_id, raw))
        self.items: dict[int, tuple[list[Item], np.ndarray]] = {}
        for size, group in sorted(by_size.items()):
            vectors = _unit(np.array([space[_terms(raw)].sum(0) for _, raw in group]))
            self.items[size] = [Item.of(i, _words(raw).tolist()) for i, raw in group], vectors.T.copy()

    def candidates(self, ids: np.ndarray, block: int) -> Iterator[tuple[Item, int, int, float]]:
        """``(item, first word, size, cosine)`` for each passage near an item.

        ``ids`` are whole blocks of terms; passages begin at every quarter of their size.
        """
        largest = max(self.items)
        stretch = max(STRETCH, largest)
        for begin in range(0, len(ids), stretch):
            # Each stretch reads on as far as its last passages reach.
            part = ids[begin : begin + stretch + largest]
            sums = self.space[part].reshape(-1, block, RANK).sum(axis=1)
            upto = np.concatenate((np.zeros((1, RANK), dtype=np.float32), np.cumsum(sums, axis=0)))
            own = min(stretch // block, len(sums))
            for size, (items, vectors) in self.items.items():
                first = np.arange(0, own, size // 4 // block)
                last = np.minimum(first + size // block, len(sums))
                at_once = max(1, PRODUCT_CELLS // len(items))
                for begun in range(0, len(first), at_once):
                    some = slice(begun, begun + at_once)
                    own_vectors = upto[last[some]] - upto[first[some]]
                    norms = np.sqrt(np.einsum("ij,ij->i", own_vectors, own_vectors)) + np.float32(1e-9)
                    products = own_vectors @ vectors
                    row, at = np.nonzero(products >= MIN_COSINE * norms[:, None])
                    starts = (first[some][row] * block + begin).tolist()
                    for r, i, cosine in zip(starts, at.tolist(), (products[row, at] / norms[row]).tolist()):
                        yield items[i], r, size, cosine

    def find(self, texts: list[bytes]) -> list[list[tuple[int, float, float, float, int]]]:
        """``(item id, cosine, share of the item, share of its answer, first word)`` for each text, once per item.

        Texts are given by their terms. They stand in one row, each filled up to whole blocks. A passage may
        reach into the next text; the word checks look at its own text only. The
        passage with the largest share, then cosine, is told.
        """
        found: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.items or not texts:
            return [[] for _ in texts]
        block = min(self.items) // 4
        own = [_words(t) for t in texts]
        lengths = np.array([-(-len(ids) // block) * block for ids in own])
        ends = np.cumsum(lengths)
        row = np.full(int(ends[-1]), TERMS, dtype=np.intp)
        for ids, end, length in zip(own, ends, lengths):
            row[end - length : end - length + len(ids)] = ids & np.uint32(TERMS - 1)
        if not len(row):
            return [[] for _ in texts]
        starts, ends = (ends - lengths).tolist(), ends.tolist()
        # Items near the same passage come one after the other.
        last, region, distinct = None, [], set()
        for item, at, size, cosine in self.candidates(row, block):
            # A passage that begins late in one text may hold the beginning of the next ones.
            low, high = at - size // 4, at + size + size // 4
            text = bisect_right(ends, max(low, 0))
            while text < len(texts) and starts[text] < high:
                begin = max(0, low - starts[text])
                if last != (text, at, size):
                    last, region = (text, at, size), own[text][begin : high - starts[text]].tolist()
                    distinct = set(region)
                shares = item.shares(region, distinct)
                if shares and (shares[0], cosine) > found[text].get(item.item_id, (0, 0, 0.0))[2:0:-1]:
                    found[text][item.item_id] = (item.item_id, cosine, *shares, begin)
                text += 1
        return [list(f.values()) for f in found]


MATCH_SCHEMA = "doc_id bigint, item_id bigint, cosine double, item_share double, answer_share double, first_word bigint"


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in its text.

    Document frequencies count all texts, and the latent space is fitted on every
    text and item, cut into passages. Every passage of every whole text is compared with every item of its size. ``item_share`` is the part of the item's
    words that the passage has in order, ``answer_share`` that of its answer.
    Null and empty texts and items match nothing. An item that comes several
    times in a text gives one row; rows of ``docs`` or ``benchmark`` that repeat
    give a row each. A null ``doc_id`` stays null; items without id are not
    searched. Empty tables give an empty result. Other columns are not read.
    Each pass sends its items only, writes what it finds and releases them.
    """
    spark = docs.sparkSession
    items = term_table(benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()), "item_id")
    table = term_table(docs.where(F.col("text").isNotNull()), "doc_id")
    counts, number, words = document_frequencies(table)
    idf = np.log((1 + number) / (1 + counts)).astype(np.float32) + np.float32(0.01)
    lengths = items.agg(F.sum(F.octet_length("terms").cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    item_bytes = lengths["bytes"] or 0
    typical = item_bytes // (WORD_BYTES * max(1, lengths["rows"]))
    size = passage_size(int(typical or 1))
    weight = max(1.0, ITEM_PART * words / size)
    fitted = table.select("terms", F.lit(1e0).alias("weight")).unionByName(items.select("terms", F.lit(weight).alias("weight")))
    space = randomised_svd(fitted, idf, size) * idf[:, None]

    passes = max(1, -(-lengths["rows"] // ITEMS_PER_PASS), -(-item_bytes // ITEM_BYTES_PER_PASS))
    whole = None
    for i in range(passes):
        chosen = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        queries = [(r["item_id"], bytes(r["terms"])) for r in chosen.collect()]  # about ITEMS_PER_PASS
        shared = spark.sparkContext.broadcast((space, queries))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            names = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for batch in batches:
                for at in range(0, len(batch), TEXTS_AT_ONCE):
                    part = batch.slice(at, TEXTS_AT_ONCE)
                    matches = searcher.find(part.column(1).to_pylist())
                    rows = [(d.as_py(), *m) for d, found in zip(part.column(0), matches) for m in found]
                    if rows:
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        found = materialize(table.mapInArrow(searched, MATCH_SCHEMA))
        shared.destroy()
        whole = found if whole is None else whole.unionByName(found)
    return whole


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found; all columns stay.

    A row without id is judged by its text alone, so its matches cannot be
    joined by id: documents are told apart by id and text.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text")
    hits = find_items(keyed, benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(materialize(hits), key == F.col("_hit"), "left_anti")
