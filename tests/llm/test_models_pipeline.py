"""Held-out accuracy of the learned operators, and the pipeline's stages."""

from zlib import crc32

import corpus_pipeline
from subsight.llm import langid, toxicity
from subsight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93


def test_toxicity_edges(spark):
    rows = [(i, "you idiot there" if i % 3 == 0 else "a kind word", "s", 1) for i in range(60)] + [(None, "idiot", None, 1), (91, None, None, 1), (92, "", None, 1), (93, "idiot " * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (91, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.add_score(docs, toxicity.fit(docs, labels)).collect()}
    assert got[0] > 0.7 > 0.5 > got[1] and got[None] > 0.5 and got[93] > 0.5
    assert got[91] == got[92] and 0 <= got[91] <= 1
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.add_score(docs, blank).collect()} == {0.5}
    assert toxicity.add_score(docs.limit(0), blank).count() == 0


def test_repeated_rows_are_learned_once(spark):
    base = [(i, f"you idiot {i}" if i % 3 == 0 else f"a kind word {i}", "en") for i in range(30)]
    docs = spark.createDataFrame(base + base[:1] * 500, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(0, 1)] * 500, "doc_id long, toxic int")
    assert toxicity._labelled(docs, labels, 10_000).count() == 30
    plain, model = toxicity.fit(docs.distinct(), labels.distinct()), toxicity.fit(docs, labels)
    assert plain.known == model.known
    assert langid.fit(docs).langs == ["en"]


def test_machine_learns_a_pair():
    """Terms 0 and 1 are bad together only; a linear score cannot tell that."""
    import numpy as np

    docs = [[0], [1], [0, 1], []] * 200
    model = toxicity.learn(docs, np.array([0.0, 0, 1, 0] * 200), {0: 0, 1: 1})
    assert model.score([0, 1]) > 0.7 and max(model.score([0]), model.score([1])) < 0.3


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op10_language"](spark, SF).collect() if r.held_out]
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97


def test_language_edges(spark):
    rows = [(i, ("the cat and the dog", "der Hund und die Katze")[i % 2], ("en", "de")[i % 2], 1) for i in range(60)]
    rows += [(70, None, "en", 1), (71, "", "en", 1), (72, "123 !?", None, 1), (None, "und der Hund", None, 1), (73, "the dog " * 200_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.add_language(docs, langid.fit(docs)).collect()}
    assert got[70] == got[71] == got[72] == ("und", 0.0)
    assert got[None][0] == "de" and got[73][0] == "en" and 0 < got[73][1] <= 1
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.add_language(docs, empty).collect()} == {"und"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert len(ids) > 0.75 * before.count() and ids <= {r.doc_id for r in before.select("doc_id").collect()}, name
        before = corpus_pipeline.materialize(after)
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= ids


def test_near_duplicates_keep_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "other words stand here now"), (None, "a b c d e"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, _text string, _kept_score int, row_key string"


def rows_of_docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "t", 1, "r") for i, t in pairs], DOCS)


LONG = "a long text of ordinary words that says nothing much at all " * 3000
PAIRS = [
    (3, "one two three four five six"),
    (5, "one two three four five six"),
    (5, "seven eight nine ten eleven twelve"),
    (None, "one two three four five six"),
    (None, "words of a text that has no id at all"),
    (None, "words of a text that has no id at all"),
    (None, "another text that has no id and is alone"),
    (7, None),
    (8, ""),
    (9, LONG),
    (9, LONG),
]


def test_near_duplicates_lose_no_text(spark):
    """One row of each component; ids that repeat or lack join nothing."""
    kept = corpus_pipeline.drop_near_duplicates(spark, rows_of_docs(spark, PAIRS), "")
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted(
        [
            (3, "one two three four five six"),
            (5, "seven eight nine ten eleven twelve"),
            (None, "words of a text that has no id at all"),
            (None, "another text that has no id and is alone"),
            (7, None),
            (9, LONG),
        ],
        key=str,
    )


def test_stages_on_odd_rows(spark):
    """Null, empty, long and repeated rows, extra columns of helper names and empty tables pass every stage."""
    docs = rows_of_docs(spark, PAIRS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if name in ("toxicity", "line dedup", "benchmark decontamination"):
            assert rows == sorted(PAIRS, key=str), name
        else:
            assert {t for _, t in rows} <= {t for _, t in PAIRS}, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
