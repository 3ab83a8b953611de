"""Whitening against numpy's own eigenvectors, exact sums in Python's integers, and odd tables."""

import math

import numpy as np
import pytest

from shotloom.llm import queries, whitening


def reference(vectors, k=32):
    """(whitened, explained) by a dense eigenvalue solver."""
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in v] for v in vectors], float)
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    kept = e > 1e-12 * e[0]
    return c @ q[:, kept] / np.sqrt(e[kept]), e[kept] / np.trace(v)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(3)


def run(df):
    rows = sorted(whitening.whiten(df).collect(), key=lambda r: r.vec_id)
    return rows, np.array([r.whitened for r in rows])


def check(rows, got, vectors):
    want, explained = reference(vectors)
    assert got.shape == want.shape
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    assert np.abs(np.array(rows[0].explained) - explained).max() < 1e-12
    assert rows[0].identity_error < 1e-10 and len({r.identity_error for r in rows}) == 1
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [r.deviation for r in rows] == [sum((len(x) * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]


def test_filtered_iteration_finds_the_components(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((700, 96)) * np.linspace(3, 1, 96)).astype(np.float32).tolist()
    rows, got = run(table(spark, [(i, v, "x") for i, v in enumerate(vectors)]))
    check(rows, got, vectors)


@pytest.mark.parametrize("d,n", [(1, 20), (5, 50), (40, 300), (64, 33)])
def test_narrow_and_few_vectors(spark, d, n):
    r = np.random.default_rng(d)
    vectors = (r.standard_normal((n, d)) * 2).astype(np.float32).tolist()
    rows, got = run(table(spark, [(i, v, "x") for i, v in enumerate(vectors)]))
    check(rows, got, vectors)


@pytest.mark.parametrize("spectrum", [np.ones(80), np.linspace(1, 1.01, 80), np.logspace(0, -9, 80), np.r_[np.ones(40), np.full(40, 1e-8)]])
def test_spectra(spectrum):
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((80, 80)))[0]
    v = (q * spectrum) @ q.T
    passes = []

    def times(x):
        passes.append(x.shape[1])
        return v @ x

    e, y, left = whitening.components(times, 80)
    assert np.abs(e - np.sort(spectrum)[::-1][:32]).max() < 1e-12
    assert np.abs(y.T @ y - np.eye(32)).max() < 1e-12
    assert np.linalg.norm(v @ y - y * e, axis=0).max() <= 1e-12 * spectrum.max() and left.max() <= 1e-12 * spectrum.max()
    assert len(passes) < 300


def test_rows_without_a_place(spark):
    r = np.random.default_rng(5)
    good = [(i, v, "x") for i, v in enumerate(r.standard_normal((60, 6)).astype(np.float32).tolist())]
    bad = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (103, [float("nan")] * 6, "x"), (104, [float("inf")] + [0.0] * 5, "x"), (105, [1.0] * 5, "x")]
    rows, got = run(table(spark, good + bad))
    check(rows, got, [v for _, v, _ in good])
    none = table(spark, [*good[:10], (None, [0.5] * 6, "x"), *[(7, good[7][1], "x")] * 5])
    rows = whitening.whiten(none).collect()
    assert len(rows) == 16 and sum(r.vec_id is None for r in rows) == 1 and {r.n for r in rows} == {16}


def test_tables_without_variance(spark):
    assert whitening.whiten(table(spark, []).where("false")).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], "x")])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0], "x") for i in range(9)])).count() == 0


def test_large_entries_and_small_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    vectors = np.round(r.standard_normal((50, 4)) * 1e6).astype(np.float32).tolist()
    rows, got = run(table(spark, [(i, v, "x") for i, v in enumerate(vectors)]))
    want, _ = reference(vectors)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [r.deviation for r in rows] == [d if d < 2**63 else None for v in x for d in [sum((len(x) * a - s) ** 2 for a, s in zip(v, sums, strict=True))]]


def test_query(spark):
    rows = queries.op13_whiten(spark, "/root/testdata/sf0.001").toPandas()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got = rows.pivot(index="vec_id", columns="component", values="whitened")
    want, explained = reference([vectors[i] for i in got.index])
    assert list(got.columns) == list(range(1, want.shape[1] + 1))
    assert np.abs(np.abs(got.to_numpy()) - np.abs(want)).max() < 1e-7
    assert np.abs(rows.groupby("component").explained.first().to_numpy() - explained).max() < 1e-12
