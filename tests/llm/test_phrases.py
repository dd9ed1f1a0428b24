"""The FM-index against plain searching, collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from subsight.llm import phrases
from subsight.llm.fm_index import FMIndex, index

SCHEMA = "doc_id long, text string, lang string, phrase string, f string, n string, size string"


def sequence_of(pieces):
    return np.array([0, *[w for p in pieces for w in [*p, 0]]], dtype=np.int32)


@pytest.mark.parametrize("sides", [("right", "left", "right"), ("left", "left", "left"), ("right", "right", "left")])
def test_intervals_and_extensions(sides):
    rng = random.Random(4)
    pieces = [[rng.randrange(1, 5) for _ in range(rng.randrange(9))] for _ in range(60)]
    fm = FMIndex(*index(sequence_of(pieces)))
    level = fm.words()
    for size in range(1, 5):
        expected = Counter(tuple(p[i : i + size]) for p in pieces for i in range(len(p) - size + 1))
        assert {tuple(w): int(n) for w, n in zip(level.words.tolist(), level.counts)} == expected
        if size < 4:
            grown = fm.extend(level, sides[size - 1])
            own = level.words[grown.owners]
            assert (grown.words[:, 1:] if sides[size - 1] == "left" else grown.words[:, :-1]).tolist() == own.tolist()
            # An extension of part of a level is part of the extension.
            some = fm.extend(level.where(slice(0, 3)), sides[size - 1])
            assert {tuple(w) for w in some.words.tolist()} <= {tuple(w) for w in grown.words.tolist()}
            level = grown


def brute(rows, least, top):
    counts, words = {}, Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [
                b
                for q, b in f.items()
                if b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    common = ["in the Middle of", "in the end", "new york city", "é à ü"]
    rows = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.3 else rng.choice("the in of a b c D e\x0bf g\x00  ").strip(" ") for _ in range(rng.randrange(40))]
        marks = [rng.choice([" ", "  ", "\t", ", ", "\n", " . ", "!?"]) if rng.random() < 0.4 else " " for _ in words]
        rows.append(("".join(w + m for w, m in zip(words, marks)), rng.choice(["en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("  .,;", "xx"), ("new york city " * 400, "en")] + rows[:20]


@pytest.mark.parametrize("shard_words", [phrases.SHARD_WORDS, 200])
def test_collocations_against_plain_counting(spark, monkeypatch, shard_words):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard_words)
    rows = texts(shard_words)
    df = spark.createDataFrame([(i % 7, t, lang, "p", "f", "n", "s") for i, (t, lang) in enumerate(rows)], SCHEMA)
    found = phrases.collocations(df.repartition(4), min_count=5, top=12)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, 12)


def test_a_full_filter_hides_nothing(spark):
    docs = spark.createDataFrame(texts(9), "text string, lang string")
    frequent = phrases._count_words(phrases.shards_of(docs)).where("f >= 5")
    held = {(r["lang"], r["phrase"]) for r in frequent.collect()}
    for bits in (64, 1 << 20):
        made = phrases.filter_of(phrases._hashed(frequent), bits)
        assert len(made.bits) == bits // 8
        for lang, word in held:
            hashed = np.array([[phrases.xxhash.xxh64_intdigest(word)]], dtype=np.uint64)
            assert made.holds(phrases.phrase_hashes(hashed, lang)).all()
    others = np.arange(1000, dtype=np.uint64)[:, None]
    assert made.holds(phrases.phrase_hashes(others, "en")).mean() < 0.01


@pytest.mark.parametrize("bits", [64, 256])
def test_collocations_with_a_crowded_filter(spark, monkeypatch, bits):
    rows = texts(5)
    monkeypatch.setattr(phrases.filter_of, "__defaults__", (bits,))
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, min_count=5, top=12).collect()) == brute(rows, 5, 12)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).collect() == []
    rare = spark.createDataFrame([(1, "only once here", "en", "", "", "", "")], SCHEMA)
    assert phrases.collocations(rare).collect() == []



def test_scores_of_huge_counts(spark):
    many = 10**13
    row = spark.range(1).selectExpr(
        f"({phrases.SCORE_SCALE} * cast({many} AS decimal(19,0))) div (cast({many} AS decimal(19,0)) + {many + 3}) AS score"
    )
    assert row.collect()[0]["score"] == 2_000_000 * many // (2 * many + 3)
