"""Whitening against numpy on whole tables."""

import math

import numpy as np
import pytest

from sparkloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x string, n int"


def brute(vectors, k=4):
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * a - s for a, s in zip(r, sums, strict=True)] for r in x], dtype=float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, e[::-1], v[:, ::-1][:, :k]


def rows_of(seed, count, dim):
    r = np.random.default_rng(seed)
    v = (r.normal(size=(count, dim)) * np.linspace(3, 0.2, dim)).astype(np.float32)
    return [(i, [float(c) for c in v[i % (count - 3)]], "c", "x", 1) for i in range(count)]


@pytest.mark.parametrize("fan_in", [2, 16])
def test_whiten(spark, fan_in, monkeypatch):
    rows = rows_of(1, 203, 9)
    bad = [(900, None, "", "", 0), (901, [1.0, None] + [0.0] * 7, "", "", 0), (902, [float("nan")] * 9, "", "", 0), (903, [float("inf")] * 9, "", "", 0)]
    monkeypatch.setattr(whitening.tall_qr, "__defaults__", (fan_in,))
    monkeypatch.setattr(whitening, "ROWS", 7)
    docs = spark.createDataFrame(rows + bad + [(None, rows[0][1], "", "", 0)], SCHEMA).repartition(7)
    got = whitening.whiten(docs).collect()
    x, n, sums, e, v = brute([r[1] for r in rows])
    assert n == 200 and len(got) == 4 * 204
    assert sum(r["vec_id"] is None for r in got) == 4
    by = {r[0]: [math.floor(256 * c) for c in r[1]] for r in rows} | {None: [math.floor(256 * c) for c in rows[0][1]]}
    for r in got:
        far = [n * a - s for a, s in zip(by[r["vec_id"]], sums, strict=True)]
        j = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, sum(c * c for c in far))
        want = np.array(far, dtype=float) / n @ v[:, j] / math.sqrt(e[j])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
        assert abs(r["explained"] - e[j] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9
    signs = {(r["component"], np.sign(r["whitened"]) == np.sign(np.array([n * a - s for a, s in zip(by[r["vec_id"]], sums, strict=True)], dtype=float) @ v[:, r["component"] - 1])) for r in got}
    assert len(signs) == 4


def test_tree_equals_one_factor(spark):
    rows = rows_of(3, 150, 6)
    fit = spark.createDataFrame([([math.floor(256 * c) for c in r[1]],) for r in rows[:147]], "x array<bigint>").repartition(11)
    n, sums = whitening._exact_sums(fit, 6)
    x = np.array([r[0] for r in fit.collect()])
    assert (n, sums) == (147, x.sum(axis=0).tolist())
    r = whitening.tall_qr(fit, n, sums, fan_in=3)
    centred = x - x.mean(axis=0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, centred.T @ centred, rtol=1e-12, atol=1e-6)


def test_odd_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "", "", 0) for i, v in enumerate(rows)], SCHEMA)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([None, [None]])).collect() == []
    assert whitening.whiten(frame([[], []])).collect() == []
    one = whitening.whiten(frame([[1.0, 2.0], [1.0, 2.0]])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    short = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame([[1.0], [1.0, 2.0], [3.0, 5.0]])).collect()}
    assert len(short) == 6 and short[0, 1]["n"] == 3 and all(r["whitened"] is not None for r in short.values())
    huge = whitening.whiten(frame([[3e38, 1.0], [-3e38, 2.0], [0.0, 5.0]])).collect()
    assert {r["deviation"] for r in huge} >= {None}
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in huge)  # too small beside the first


def test_sums_of_squares_are_exact():
    y = np.array([[3_000_000_000, 4], [2, 1]])
    assert whitening.square_sums(y) == [9_000_000_000_000_000_016, 5]
    assert whitening.square_sums(np.array([[4_000_000_000, 0]])) == [None]
