import math
from fractions import Fraction

import numpy as np
import pytest

from kohorta.llm.whitening import EXACT, eigen, whiten


def from_values(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(EXACT)
    for _ in range(3):  # orthonormal in the wide type
        q = q + q @ (np.eye(len(q), dtype=EXACT) - q.T @ q) / 2
    return (q * np.array(values, EXACT)) @ q.T, q


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], list(range(60, 0, -1)), [7, 7, 7, 2, 1], [1, 1, 1, 1], [3, 3 - 1e-6, 3 - 2e-6, 1], [1e8, 1, 1e-8, 0], [2, 2 - 1e-10, 2 - 3e-10, 2 - 5e-10, 1, 1 - 1e-12, 0.5],
    [1 + 1e-13 * i for i in range(12)], [0, 0, 0], [1e-300, 2e-300]])
def test_pairs_are_exact_to_the_wide_type(values):
    a, _ = from_values(values, len(values))
    got, x = eigen(a)
    top = max(map(abs, values)) or 1
    unit = np.finfo(EXACT).eps * 40 * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= unit
    assert np.abs(a @ x - x * got).max() <= unit * top
    assert np.abs(got - np.sort(np.array(values, EXACT))[::-1]).max() <= unit * top


def test_near_clusters_are_told_apart():
    """Gaps of 1e-10, far under what 32-bit floats see: the vectors are still those of the matrix."""
    values = [2, 2 - 1e-10, 2 - 3e-10, 1, 0.5]
    a, q = from_values(values, 3)
    overlap = np.abs(eigen(a)[1].T @ q)
    assert np.abs(overlap - np.eye(5)).max() < 1e-7
    assert np.abs(np.abs(np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].T @ q.astype(float)) - np.eye(5)).max() > 1e-2


def brute(rows, scale):
    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in e]) for i, e in rows
            if e is not None and None not in e and all(map(math.isfinite, e))]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * v - s, n) for v, s in zip(x, sums)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    return kept, n, sums, v


def test_rows_against_exact_arithmetic(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 100]) for i in range(90)]
    rows += [(500 + i, [101.0, 99.0, 100.0, 100.5, 100.25, 100.0]) for i in range(60)]  # one vector holds many rows
    rows += [(7, rows[7][1]), (None, rows[3][1]), (601, None), (602, [1.0, None]), (603, [math.nan] * 6), (604, [-math.inf]), (605, [1.0]), (606, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n int, Component string")
    kept, n, sums, v = brute(rows, 256)
    got = whiten(df).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    values, axes = np.linalg.eigh(v)
    want = {}
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums)]
        z = np.array(d, float) / n @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
        for c in range(4):
            want.setdefault((i, c + 1), []).append((sum(a * a for a in d), z[c]))
    found, sign = {}, {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    for key, pairs in want.items():
        mine = sorted(found[key])
        for (d, z), (e, w) in zip(sorted(pairs), mine):
            sign.setdefault(key[1], np.sign(z * w))
            assert d == e and w * sign[key[1]] == pytest.approx(z, rel=1e-6, abs=1e-9)


def test_degenerate_tables(spark):
    shape = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], shape)).collect() == []
    assert whiten(spark.createDataFrame([(1, []), (2, None)], shape)).collect() == []
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], shape)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True}
    assert all(abs(r.identity_error) < 1e-12 for r in line)
    large = whiten(spark.createDataFrame([(i, [1e30 * (i % 3), -1e12 * i, 0.1]) for i in range(9)], shape)).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in large) and len(large) == 27
