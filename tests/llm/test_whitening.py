"""Whitening against a dense eigensolver, and its solver against singular values."""

import math
import os

import numpy as np
import pytest

from barloom.llm import queries, whitening

SF_DIR = os.environ.get("BARLOOM_TEST_DIR", "/root/testdata/sf0.001")


def plain(vectors, most=16):
    """Per id: exact deviation; and whitened values, eigenvalue shares, n."""
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    far = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s)) for _, v in rows]
    return [i for i, _ in rows], far, ((n * x - s) / n) @ vecs / np.sqrt(values), values / (centred**2).sum() * n, n


def check(got, vectors, most=16):
    ids, far, y, shares, n = plain(vectors, most)
    assert len(got) == len(ids) * len(shares)
    held = {}
    for r in got:
        held.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-9
    sign = None
    for i, d, row in zip(ids, far, y):
        mine = held[i, d]
        w = np.array([mine[c + 1]["whitened"] for c in range(len(row))])
        sign = np.sign(w * row) if sign is None else sign
        assert np.allclose(w, sign * row, atol=1e-8)
        assert np.allclose([mine[c + 1]["explained"] for c in range(len(row))], shares, rtol=1e-9)


def test_query_equals_dense_solver(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    check(queries.op11(spark, SF_DIR).collect(), vectors)


def test_many_blocks_repeats_and_unusable_rows(spark, rnd):
    vectors = [(i, [rnd.gauss(0, 1 + k) for k in range(6)]) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 450)]
    vectors += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(40).selectExpr("*", "vec_id AS x", "embedding AS n", "vec_id AS component", "vec_id AS whitened")
    check(whitening.whiten(df, components=4).collect(), vectors, 4)


def test_degenerate_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, []), (2, [])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    two = run([(1, [1.0, 2.0, 5.0]), (2, [1.0, 2.5, 5.0]), (3, [1.0, 2.0, 5.0]), (4, [7.0])])
    assert {(r["vec_id"], r["component"], r["n"], round(r["whitened"], 9), r["explained"]) for r in two} == {(1, 1, 2, -1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, -1.0, 1.0)}
    with pytest.raises(Exception, match="more than a long"):
        run([(1, [1e9]), (2, [-1e9])])


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "clustered", "deficient", "zero", "one"])
def test_solver_finds_singular_values_and_directions(kind):
    g = np.random.default_rng(5)
    n = {"one": 1}.get(kind, 40)
    q, p = (np.linalg.qr(g.normal(size=(n, n)))[0] for _ in range(2))
    s = {"plain": g.uniform(1, 2, n), "graded": 10.0 ** -np.linspace(0, 12, n), "equal": np.ones(n), "clustered": 1 + 1e-9 * np.arange(n), "deficient": np.r_[g.uniform(1, 2, 7), np.zeros(max(n - 7, 0))],
         "zero": np.zeros(n), "one": np.array([3.0])}[kind]
    r = np.linalg.qr(q * s @ p, mode="r")
    a, b, v = whitening.bidiagonal(r)
    dense = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
    assert np.allclose(np.sqrt(whitening.dqds(a, b)), dense, rtol=1e-10, atol=1e-14)
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-12)
    values, basis = whitening.directions(r, 16)
    want = np.sort(s)[::-1][:16]
    want = want[want > 1e-13 * max(want[0], 1e-300)]
    assert len(values) == len(want) and np.allclose(np.sqrt(values), want, rtol=1e-6)
    if len(values):
        assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-9)
        assert np.allclose(r.T @ (r @ basis), basis * values, atol=1e-11 * values[0])
