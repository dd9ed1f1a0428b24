"""Fingerprints and SimHash components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from subsight.llm import fingerprints, simhash
from subsight.llm.components import connected

DOCS = "doc_id long, text string, fingerprint string, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def words_of(rng, n):
    return [rng.choice("the of and dog cat Tree River stone".split()) + str(rng.randrange(300)) for _ in range(n)]


def brute_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_all_pairs(spark):
    rng = random.Random(1)
    base = [words_of(rng, 400) for _ in range(12)]
    rows = [(10, None), (11, ""), (12, " \t"), (13, "One"), (None, "one"), (14, "two words")]
    for i in range(90):
        words = list(base[i % 12])
        for _ in range(i % 4):
            words[rng.randrange(400)] = "new"
        rows.append((100 + i, " ".join(words)))
    rows += [(100, rows[6][1]), (500, "x " * 70_000)]
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = {t: brute_simhash(t) for _, t in rows}
    classes = sorted(set(prints.values()))
    root = {c: c for c in classes}
    for _ in classes:
        for a in classes:
            for b in classes:
                if (a ^ b).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    expected = Counter((i, prints[t], least.get(root[prints[t]])) for i, t in rows)
    assert Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in found) == expected
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_every_near_pair_once(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for n in range(1, 6):
            w = v
            for b in rng.sample(range(64), n):
                w ^= 1 << b
            values.add(w)
    signed = [simhash._signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for bits in (1, 3, 4, 6):
        found = Counter((r.a, r.b) for r in simhash.near_pairs(df, bits).collect())
        near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert found == Counter(near)


def test_variants_are_not_broadcast(spark):
    """Few fingerprints by Spark's count of bytes are 64 times as many variants."""
    few = spark.range(1000).select(F.xxhash64("id").alias("fingerprint"))
    plan = simhash.near_pairs(few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in connected(links, "u", "v").collect()} == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_edited_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words_of(rng, 200))) for i in range(40)] + [(50, None), (51, ""), (52, "é" * 9), (None, "last of all")]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    found = {r.doc_id: r for r in fingerprints.compare_edited(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert found[i].n_chars == len(t)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) > 500:
            shingles = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (t.lower().split(), edited.lower().split())]
            real = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
            assert abs(found[i].near_edited - real) < 0.12
    assert fingerprints.compare_edited(docs_of(spark, [])).count() == 0
    alone = fingerprints.compare_edited(docs_of(spark, [(1, "a b c d e f g h")])).first()
    assert alone.near_next == 1.0


def test_packing_and_short_texts():
    make = fingerprints.Fingerprinter()
    for text in (b"one", b"a b c d e", b"a b c d e f g", b" ".join(b"w%d" % i for i in range(5000))):
        codes = make(text)
        assert (fingerprints.unpacked(fingerprints.packed(codes)) == codes).all()
        assert fingerprints.likeness(codes, codes) == 1.0
    assert fingerprints.packed(make(b" \n")) == "" and fingerprints.likeness(None, codes) == 0.0
    assert np.array_equal(make(b"A b C d e f"), make(b"a  b\nc d e f"))


def test_fingerprints_of_a_table(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (1, text), (2, text.upper()), (3, None), (4, " "), (None, "alone"), (6, "word " * 200_000)]
    schema = "doc_id long, text string, fingerprint int, _text string, own_text string, `a b` struct<`c d`:int>"
    docs = spark.createDataFrame([(i, t, 5, "x", "y", (7,)) for i, t in rows], schema)
    got = fingerprints.add_fingerprint(docs)
    assert got.columns == ["doc_id", "text", "_text", "own_text", "a b", "fingerprint"]
    found = {}
    for r in got.collect():
        assert r["_text"] == "x" and r["own_text"] == "y" and r["a b"][0] == 7
        found.setdefault(r.doc_id, []).append(r.fingerprint)
    assert found[1][0] == found[1][1] == found[2][0] != "" and found[3] == found[4] == [""]
    assert found[None][0] not in ("", found[1][0]) and len(found[6]) == 1
    assert fingerprints.add_fingerprint(docs.limit(0)).count() == 0
