"""Packing: ids as the tokenizer's own library gives them, whole pieces, gapless and few sequences."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from subsight.llm import packing
from subsight.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)


def own_ids(text: str | None) -> list[int]:
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_library(text):
    assert packing.token_ids(PATH, text).tolist() == own_ids(text)[:-1]


@pytest.mark.parametrize("text", ["", " ", "a" * 9000, "it's  a\r\n\ttest ", "<|endoftext|> a<|endoftext|>", "日本 ½ ²", "\x00\x7f"])
def test_ids_of_special_texts(text):
    assert packing.token_ids(PATH, text).tolist() == own_ids(text)[:-1]


@pytest.mark.parametrize("length", [1, 2, 7, 8, 9, 16, 17])
def test_cut(length):
    pieces = packing.cut(np.zeros(length), 8)
    assert [s for s, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1]
    assert sum(n for _, n in pieces) == length
    assert all(n == 8 for _, n in pieces[1:]) and 1 <= pieces[0][1] <= 8


def least(lengths: tuple[int, ...], capacity: int) -> int:
    """Fewest sequences by trying every way."""
    best = len(lengths)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[j] -= lengths[i]
            place(i + 1, rooms)
            rooms[j] += lengths[i]
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def places(plan: packing.Plan, counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    held = defaultdict(list)
    for length in np.flatnonzero(counts).tolist():
        for s, o in zip(*plan.place(length, np.arange(counts[length]))):
            held[int(s)].append((int(o), length))
    return held


def check(held: dict[int, list[tuple[int, int]]], capacity: int) -> None:
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_small_plans_against_every_packing(lengths):
    counts = np.bincount(lengths, minlength=13) if lengths else np.zeros(13, dtype=int)
    plan = packing.plan(counts)
    held = places(plan, counts)
    check(held, 12)
    fewest = least(tuple(sorted(lengths, reverse=True)), 12)
    assert plan.bound - 1e-9 <= fewest <= len(held) == plan.total <= fewest + 1


def test_knapsack_against_all_fillings():
    rng = np.random.default_rng(0)
    for _ in range(20):
        prices = np.where(rng.random(13) < 0.5, rng.random(13), 0)
        prices[0] = 0
        best, first = packing._priced(prices)
        worth = [0.0] * 13
        for room in range(1, 13):
            worth[room] = max(worth[room - 1], *(prices[n] + worth[room - n] for n in range(1, room + 1)))
        assert np.allclose(best, worth)
        filled = packing._filled(first, 12)
        assert sum(filled) <= 12 and math.isclose(sum(prices[n] for n in filled), best[-1])


@pytest.mark.parametrize("case", ["even", "halves", "thirds", "quarters", "long", "one"])
def test_large_plans_come_near_the_bound(case):
    rng = np.random.default_rng(1)
    n, capacity = 60_000, 256
    lengths = {
        "even": rng.integers(1, capacity + 1, n),
        "halves": rng.choice([129, 127, 100, 28], n, p=[0.25, 0.25, 0.25, 0.25]),
        "thirds": rng.choice([85, 86, 171], n),
        "quarters": rng.choice([60, 65, 70, 97, 130], n),
        "long": rng.integers(150, 200, n),
        "one": np.full(n, 200),
    }[case]
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.plan(counts)
    check(places(plan, counts), capacity)
    assert plan.bound - 1e-6 <= plan.total
    if case in ("long", "one"):  # no two of them fit together
        assert plan.total == n
    else:
        assert plan.total <= plan.bound * (1.015 if case in ("thirds", "quarters") else 1.002) + 2


def test_the_program_covers_most_pieces():
    lengths = np.random.default_rng(2).integers(1, 257, 200_000)
    counts = np.bincount(lengths, minlength=257)
    taken, bound = packing.fractional(counts)
    covered = np.zeros(257)
    for config, often in taken.items():
        assert sum(k * n for k, n in config) <= 256
        for k, n in config:
            covered[k] += often * n
    assert (covered <= counts + 1e-6).all()
    assert covered.sum() >= 0.8 * counts.sum()
    assert sum(taken.values()) <= bound * 1.005


def whole(rows, texts, capacity):
    """Every document's ids, once and in order; sequences without gaps. Returns their number."""
    held = defaultdict(list)
    found = Counter()
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        found[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    check(held, capacity)
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array(own_ids(text), dtype="<u4")
        for i, (start, n) in enumerate(packing.cut(ids, capacity)):
            expected[(doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert found == expected
    return len(held)


def test_edges(spark):
    texts = [(1, None), (2, ""), (None, "one two"), (None, "one two"), (5, "word " * 3000), (5, "other"), (7, "x")]
    schema = "doc_id long, text string, piece string, length string, rank string, sequence_id string"
    rows = [(i, t, "a", "b", "c", "d") for i, t in texts] + [(i, "same text here", "a", "b", "c", "d") for i in range(900)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    found = packing.pack(df, capacity=16).collect()
    many = whole(found, [(r[0], r[1]) for r in rows], 16)
    tokens = sum(r["length"] for r in found)
    assert many <= math.ceil(tokens / 16) + 1
    empty = packing.pack(spark.createDataFrame([], schema))
    assert empty.collect() == []


def test_query_over_the_whole_table(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op12_packed_sequences"](spark, sf_dir).collect()
    many = whole(found, texts, 2048)
    assert many <= math.ceil(sum(r["length"] for r in found) / 2048) + 1
