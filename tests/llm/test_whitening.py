"""Whitening against a dense eigendecomposition and plain sums, and its parts on hard matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgrid.llm import whitening as W

SCHEMA = "id long, vector array<float>, component string, n string, vec_id int, v string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n", 0, "v", 1) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=8):
    """id: (deviation, coordinates up to sign), the shares and the eigenvalues, by numpy on all rows at once."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return deviation, y @ q / np.sqrt(e), e / np.trace(y.T @ y / n), e


@pytest.mark.parametrize("d", [64, 3, 1])
def test_against_dense_eigenvectors(spark, d):
    r = np.random.default_rng(d)
    mixed = r.standard_normal((300, d)) @ r.standard_normal((d, d)) / 10
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(mixed)]
    deviation, want, shares, _ = plain(rows)
    got = {(x["id"], x["component"]): x for x in W.whiten(table(spark, rows)).collect()}
    k = min(8, d)
    assert set(got) == {(i, c) for i in range(300) for c in range(1, k + 1)}
    have = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in range(300)])
    signs = np.sign((have * want).sum(axis=0))
    np.testing.assert_allclose(have * signs, want, rtol=0, atol=1e-9)
    assert [int(got[i, 1]["deviation"]) for i in range(300)] == deviation
    np.testing.assert_allclose([got[0, c]["explained"] for c in range(1, k + 1)], shares, rtol=1e-10)
    assert {x["n"] for x in got.values()} == {300} and all(x["identity_error"] < 1e-9 for x in got.values())


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    fine = [(k, r.standard_normal(4).tolist()) for k in range(50)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0, math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0, 0.0]), (104, [1.0] * 5), (105, []), (5, fine[5][1]), (5, fine[5][1]), (None, fine[6][1])]
    got = W.whiten(table(spark, fine + odd)).collect()
    rows = fine + odd[-3:]
    deviation, want, _, _ = plain(rows)
    assert len(got) == len(rows) * 4 and {x["n"] for x in got} == {53}
    first = sorted(abs(x["whitened"]) for x in got if x["component"] == 1)
    np.testing.assert_allclose(first, sorted(abs(want[:, 0])), atol=1e-9)
    assert sorted(int(x["deviation"]) for x in got if x["component"] == 1) == sorted(deviation)
    assert sum(x["id"] is None for x in got) == 4 and sum(x["id"] == 5 for x in got) == 12


def test_nothing_to_whiten(spark):
    assert W.whiten(table(spark, []).limit(0)).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, []), (3, [math.nan])])).collect() == []
    assert W.whiten(table(spark, [(k, [1.0, 2.0, 3.0]) for k in range(5)])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    # two dimensions of three differ
    got = W.whiten(table(spark, [(k, [float(k), float(k * k % 7), 5.0]) for k in range(20)])).collect()
    assert {x["component"] for x in got} == {1, 2} and all(x["identity_error"] < 1e-9 for x in got)


def test_huge_entries(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [1e15, 2.0]), (3, [0.0, 3.0])]
    got = W.whiten(table(spark, rows)).collect()
    assert {x["component"] for x in got} == {1} and len(got) == 4  # the other one is a rounding error of the first
    assert all(math.isfinite(x["whitened"]) for x in got)
    assert all(x["deviation"] is None or x["deviation"] < 10**38 for x in got)


@pytest.mark.parametrize("kind", ["random", "repeated", "diagonal", "clustered", "low rank", "arrow"])
def test_eigenvectors_of_hard_matrices(kind):
    r = np.random.default_rng(7)
    d = 40
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    e = {"random": r.random(d), "repeated": np.repeat(r.random(8), 5), "clustered": 1 + 1e-9 * np.arange(d), "low rank": np.r_[1.0, 0.5, np.zeros(d - 2)]}.get(kind)
    a = np.diag(r.random(d)) if kind == "diagonal" else np.diag(np.arange(1.0, d + 1)) if kind == "arrow" else q * e @ q.T
    if kind == "arrow":
        a[0, :] = a[:, 0] = 1e-6
    a = (a + a.T) / 2
    values, vectors = W.leading(a, 8)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-12 * max(1, np.abs(a).max()))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-10)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-10 * max(1, np.abs(a).max()))


def test_sturm_counts():
    r = np.random.default_rng(3)
    diagonal, off = r.standard_normal(30), r.standard_normal(29)
    off[[4, 17]] = 0
    full = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-5, 5, 41)
    np.testing.assert_array_equal(W.below(diagonal, off, at), (np.linalg.eigvalsh(full)[:, None] < at).sum(axis=0))


def test_registered_query(spark, small):
    got = W.op13_embedding_whitening(spark, small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    deviation, want, shares, _ = plain(rows)
    have = got.orderBy("vec_id", "component").collect()
    assert len(have) == 8 * len(rows)
    order = np.argsort([i for i, _ in rows], kind="stable")
    assert [r["deviation"] for r in have[::8]] == [deviation[i] for i in order]
    np.testing.assert_allclose([abs(r["whitened"]) for r in have], np.abs(want[order]).ravel(), atol=1e-6)
    np.testing.assert_allclose([r["explained"] for r in have[:8]], shares, rtol=1e-9)
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
