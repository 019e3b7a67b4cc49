"""Whitening against exact integer sums and a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from duelgauge.llm import whitening as W

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, T.StringType()) for n in ("x", "n", "length", "block", "place", "value", "component")]
)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *["c"] * 7) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, components=4):
    """(vec_id, component) rows by exact sums; the sign of a component is free, so values are given as absolutes."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in usable]
    out, fits = [], {}
    for length in {len(x) for x in xs}:
        fit = sorted({x for x in xs if len(x) == length})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[c - b / n for c, b in zip(x, s)] for x in fit])
        cov = centred.T @ centred / n
        e, u = np.linalg.eigh(cov)
        fits[length] = (n, s, e[::-1], u[:, ::-1], cov)
    for (i, _), x in zip(usable, xs):
        n, s, e, u, cov = fits[len(x)]
        deviation = sum((n * c - b) ** 2 for c, b in zip(x, s))
        for k in range(min(components, len(x))):
            if e[0] > 0 and e[k] > 1e-12 * e[0]:
                value = sum((c - b / n) * w for c, b, w in zip(x, s, u[:, k])) / math.sqrt(e[k])
                out.append((-1 if i is None else i, k + 1, n, deviation if deviation < 2**63 else None, abs(value), e[k] / np.trace(cov)))
    return sorted(out, key=lambda r: (r[0], r[1], r[4]))


def result(found):
    rows = [(-1 if r.vec_id is None else r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found]
    return sorted(rows, key=lambda r: (r[0], r[1], r[4]))


def close(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=0, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def vectors(seed, rows, length, scales=None):
    x = np.random.default_rng(seed).normal(0, 0.3, (rows, length)) * (scales if scales is not None else 1)
    return [[float(np.float32(c)) for c in v] for v in x]


def test_awkward_rows_copies_and_lengths(spark):
    made = vectors(1, 40, 6, np.array([3, 2, 1.5, 1, 0.7, 0.2]))
    rows = list(enumerate(made)) + [(i, made[0]) for i in range(100, 130)]  # nearly half of all rows are one vector
    rows += [(200, None), (201, []), (202, [None] * 6), (203, [float("nan")] + [0.0] * 5), (204, [float("-inf")] + [0.0] * 5)]
    rows += [(None, made[1]), (3, made[3]), (205, [-0.001] * 6)]
    rows += [(300 + k, v) for k, v in enumerate(vectors(2, 9, 2))] + [(400, [1.0, 2.0, 3.0])]
    found = W.whitened(frame(spark, rows)).collect()
    close(result(found), brute(rows))
    assert 0 < max(r.identity_error for r in found) < 1e-9
    assert not {200, 201, 202, 203, 204, 400} & {r.vec_id for r in found}


def test_close_eigenvalues_in_many_dimensions(spark):
    rows = list(enumerate(vectors(5, 300, 70)))
    close(result(W.whitened(frame(spark, rows)).collect()), brute(rows))


def test_large_entries_keep_exact_sums(spark):
    rows = [(k, [float(c) * 2.0**34 for c in v]) for k, v in enumerate(vectors(6, 12, 3))]
    got, want = W.whitened(frame(spark, rows)).collect(), brute(rows)
    assert [(r[0], r[3]) for r in result(got)] == [(r[0], r[3]) for r in want] and want[0][3] is None
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(r[4] for r in want), atol=1e-9)


def test_empty_tables_and_no_variance(spark):
    assert W.whitened(frame(spark, [(1, [1.0, 2.0])], 1).limit(0)).collect() == []
    assert W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 1)).collect() == []


@pytest.mark.parametrize("inner,space", [(2, 20), (6, 40)])
def test_jacobi_davidson_restarts_and_locks(inner, space):
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    for values in (np.arange(120, 0, -1.0), np.r_[[50, 50, 50 - 1e-6, 49, 49], np.ones(115)], np.r_[[5, 4], np.zeros(118)]):
        v = (q * values) @ q.T
        e, u = W.leading_pairs(lambda w: v @ w, 120, 4, values.sum(), inner, space)
        assert np.allclose(e, np.sort(values)[::-1][:4], atol=1e-11)
        assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-11 * values[0] and np.abs(u.T @ u - np.eye(4)).max() < 1e-13


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    v, (q, _) = a @ a.T, np.linalg.qr(rng.standard_normal((20, 3)))
    shifts, right = np.array([3.0, 60.0]), rng.standard_normal((20, 2))
    t = W.minres(lambda w: v @ w, shifts, q, right, 40)
    p = np.eye(20) - q @ q.T
    for k in range(2):
        assert np.allclose(p @ (v - shifts[k] * np.eye(20)) @ p @ t[:, k], p @ right[:, k], atol=1e-6)
