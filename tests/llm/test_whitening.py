"""Spectrum slicing and whitening against numpy and exact arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest

from subsight.llm import whitening
from subsight.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, component string, _vector string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], SCHEMA)


def made(size: int, values, seed: int = 0) -> np.ndarray:
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (turn * np.array(values)) @ turn.T


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_counts_of_eigenvalues_are_those_of_numpy(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        a = rng.normal(size=(size, size))
        a = a + a.T
        np.fill_diagonal(a, a.diagonal() * rng.choice([0, 1]))
        for shift in rng.normal(size=5) * size:
            assert whitening.eigenvalues_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


@pytest.mark.parametrize(
    "values",
    [
        [9, 7, 5, 4, 3, 2, 1, 0.5, 0.1, 0.01],
        [4, 4, 4, 1, 1, 1, 1, 1, 0, 0],
        [1] * 10,
        [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5 - 1e-14, 0.2, 0.1, 0, 0, 0],
        [1e12, 1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0],
        [0] * 10,
    ],
)
def test_eigenpairs(values):
    a = made(10, values)
    found, vectors = whitening.leading_eigenpairs(a, 8)
    assert np.allclose(found, sorted(values, reverse=True)[:8], rtol=1e-12, atol=1e-12 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-11 * max(max(values), 1e-300)


def brute(vectors, k=8):
    x = np.floor(np.array(vectors) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    e, w = np.linalg.eigh(d.T @ d / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    return n, deviation, d @ w / np.sqrt(e), e / np.trace(d.T @ d / n)


def test_whitened_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 12)) * np.arange(1, 13) + rng.normal(size=12)).tolist()
    good += good[:5]
    bad = [None, [None] + [0.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, 2.0], []]
    df = table(spark, good + bad)
    n, deviation, white, explained = brute(good)
    rows = whitening.whiten(df.repartition(7)).collect()
    assert len(rows) == 8 * len(good)
    signs = {}
    for r in rows:
        i, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
        assert abs(abs(r["whitened"]) - abs(white[i, c])) < 1e-8
        if abs(white[i, c]) > 1e-3:
            signs.setdefault(c, set()).add(r["whitened"] * white[i, c] > 0)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    again = whitening.whiten(df.coalesce(1)).collect()
    key = lambda r: (r["vec_id"], r["component"])
    for a, b in zip(sorted(rows, key=key), sorted(again, key=key)):
        assert a["whitened"] == pytest.approx(b["whitened"], abs=1e-12)


def test_flat_single_and_absent_vectors(spark):
    same = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(same) == 6
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}
    line = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert max(r["identity_error"] for r in line) < 1e-9
    for vectors in ([], [None], [[]]):
        assert whitening.whiten(table(spark, vectors)).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [[1e300, 0.0], [0.0, 1.0]])).collect()


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**33 + i), float(i * i)] for i in range(4)]
    n, deviation, _, _ = brute(vectors, 2)
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(enumerate(deviation))


def test_query_over_the_whole_table(spark, sf_dir):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, white, explained = brute(vectors)
    rows = QUERIES["op13_whitened_embeddings"](spark, sf_dir).collect()
    assert len(rows) == 8 * n
    order = sorted({r["vec_id"] for r in rows})
    place = {v: i for i, v in enumerate(order)}
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[i]
        assert abs(abs(r["whitened"]) - abs(white[i, c])) < 1e-6
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-6)
        assert r["identity_error"] <= 1e-6
