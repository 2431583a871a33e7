"""Whitening of embeddings by mixed-precision refinement of eigenvectors.

Vectors become integers, each distinct one is written once, and sums and centred products over them are exact integers that tasks
add up; only numbers per pair of dimensions reach the driver. There the covariance, exact up to its last rounding, is solved in 32-bit
floats, and the eigenvectors are corrected by matrix products in the widest float type until nothing changes (each
iteration squares the error). Eigenvalues too close for their correction to be told apart form a cluster, whose
subspace is solved on its own after its common part is taken off.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import picked, stage

#: Scaled components are held to this size.
LARGEST = 1 << 62
ITERATIONS = 40
WIDE = pa.decimal128(38, 0)
EXACT = np.longdouble
RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double")


def _norm(a):
    return np.sqrt((a * a).sum())


def _clusters(values, apart):
    """Indices of values that form chains with steps of at most ``apart``, where they are more than one."""
    order = np.argsort(values)
    edges = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, edges) if len(c) > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in the widest float type."""
    a = np.asarray(matrix, EXACT)
    size = len(a)
    largest = np.abs(a).max(initial=0)
    if largest == 0:
        return np.zeros(size, EXACT), np.eye(size, dtype=EXACT)
    scale = EXACT(2) ** np.ceil(np.log2(largest))
    a = a / scale
    unit, whole = np.finfo(EXACT).eps, _norm(a)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXACT)
    for _ in range(ITERATIONS):
        r, s = np.eye(size, dtype=EXACT) - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over small gaps bends right angles
        values = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (_norm(s - np.diag(values)) + whole * _norm(r))
        gap = values[None] - values[:, None]
        far = np.abs(gap) > apart
        fix = np.where(far, (s + values[None] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ fix
        nearest = np.abs(gap[far]).min(initial=1)
        settled = np.abs(fix).max() <= 4 * size * unit * max(1, whole / nearest)  # what rounding leaves
        for c in _clusters(values, apart):
            own = x[:, c]
            part = own.T @ (a @ own - values[c].mean() * own)
            part = (part + part.T) / 2
            if np.abs(part - np.diag(np.diag(part))).max() > 4 * size * unit:
                x[:, c], settled = own @ eigen(part)[1], False
        if settled:
            break
    x = x + x @ (np.eye(size, dtype=EXACT) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _packed(width, scale):
    """Every vector as the bytes of its integers, in the narrowest type that holds them; equal vectors have equal bytes."""
    def run(batches):
        for batch in batches:
            x = _integers(batch.column("vector"), width, scale)
            most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
            keys = np.empty(len(x), object)
            for kind, least, limit in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
                at = np.flatnonzero((most >= least) & (most < limit))
                raw, step = x[at].astype(kind).tobytes(), np.dtype(kind).itemsize * width
                keys[at] = [raw[i * step: (i + 1) * step] for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])
    return run


def _integers(lists, width, scale):
    """floor(scale * x) of each row, shorter rows filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(values, -float(LARGEST), float(LARGEST)).astype(np.int64)
    return out


def _unpacked(keys, width):
    raw = keys.to_pylist()
    out = np.zeros((len(raw), width), np.int64)
    sizes = np.array([len(k) // width for k in raw])
    for kind in ("<i2", "<i4", "<i8"):
        at = np.flatnonzero(sizes == np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, width)
    return out


def _products(y):
    """y'y, exact: through doubles or 64 bits where these hold every sum, else through Python integers."""
    most = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    sums = most * most * len(y)
    if sums < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    y = y if sums < 1 << 62 else y.astype(object)
    return y.T @ y


def _added(rows: DataFrame, part, cells: int) -> list[int]:
    """Exact sums over all rows of the integer vectors ``part(integers)`` makes of a batch."""
    def run(batches):
        total = None
        for batch in batches:
            more = np.asarray(part(batch), object)
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)),
                                              pa.array([Decimal(int(x)) for x in total], WIDE)], ["cell", "total"])
    out = [0] * cells
    found = rows.mapInArrow(run, "cell int, total decimal(38,0)").groupBy("cell").agg(F.sum("total").alias("total"))
    for cell, total in found.collect():
        out[cell] = int(total)
    return out


def _differences(x, n, sums):
    """n * x - sums, exact."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(d):
    most = max(int(d.max(initial=0)), -int(d.min(initial=0)))
    if most * most * d.shape[1] < 1 << 63:
        return pa.array((d * d).sum(axis=1).astype(np.int64))
    return pa.array([int(t) if t < 1 << 63 else None for t in (d.astype(object) ** 2).sum(axis=1)], pa.int64())


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Leading whitened components of ``vectors`` (vec_id, embedding), a row per kept row and component.

    Rows whose embedding is missing or holds a missing or non-finite entry are dropped; entries become x = floor(scale * c), held to
    2^62 in size; shorter (also empty) vectors count as filled with zeros up to the longest one. The mean and the covariance are
    those of the n distinct x vectors, each once. Returned are vec_id, component (from 1, by falling eigenvalue), n, deviation (sum
    over dimensions of (n x - S)^2, S the sums over the distinct vectors; missing where no long holds it), whitened ((x - S/n) on
    the unit eigenvector, over the root of its eigenvalue; missing for a component without variance), explained (share
    of the trace; missing without any variance), and identity_error (largest absolute entry of the covariance of whitened
    minus the identity, over the distinct vectors and the components with variance). Repeated rows and rows without
    vec_id stay; other columns are left out, whatever their names; an empty table, or one of empty vectors only,
    gives an empty result. The driver holds numbers per pair of dimensions.
    """
    spark = vectors.sparkSession
    rows = picked(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = rows.where(F.col("vector").isNotNull() & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    width = kept.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return spark.createDataFrame([], RESULT)
    fit = stage(kept.select("vector").mapInArrow(_packed(width, scale), "key binary").distinct(), "distinct-vectors")

    *sums, n = _added(fit, lambda b: [*_unpacked(b.column("key"), width).sum(axis=0, dtype=object), b.num_rows], width + 1)
    middle = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(width)

    def centred(batch):
        x, m = _unpacked(batch.column("key"), width), np.array(middle)
        return _products(x - m)[upper]
    left = [s - n * m for s, m in zip(sums, middle)]
    covariance = np.zeros((width, width), EXACT)
    trace = Fraction(0)
    for i, j, p in zip(*upper, _added(fit, centred, len(upper[0]))):
        cell = Fraction(n * p - left[i] * left[j], n * n)
        high = float(cell)
        covariance[i, j] = covariance[j, i] = EXACT(high) + EXACT(float(cell - Fraction(high)))
        trace += cell if i == j else 0
    values, axes = eigen(covariance)
    kept_axes = min(components, width)
    real = values[:kept_axes] > width * np.finfo(EXACT).eps * 8 * max(values[0], 0)
    weights = np.where(real, axes[:, :kept_axes] / np.sqrt(np.where(real, values[:kept_axes], 1)), 0).astype(float)
    explained = [float(v / EXACT(float(trace))) if trace else None for v in values[:kept_axes]]

    def projected(x):
        d = _differences(x, n, sums)
        return d, (d / n).astype(float) @ weights

    def second_moments(batches):
        total = np.zeros((kept_axes, kept_axes + 1))
        for batch in batches:
            z = projected(_unpacked(batch.column("key"), width))[1]
            total += z.T @ np.column_stack([z, np.ones(len(z))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())],
                                         ["cell", "total"])
    moments = np.zeros(kept_axes * (kept_axes + 1))
    for cell, total in fit.mapInArrow(second_moments, "cell int, total double").groupBy("cell").agg(F.sum("total")).collect():
        moments[cell] = total
    moments = moments.reshape(kept_axes, -1) / n
    off = moments[:, :-1] - np.outer(moments[:, -1], moments[:, -1]) - np.eye(kept_axes)
    error = float(np.abs(off[np.ix_(real, real)]).max()) if real.any() else None

    def result(batches):
        for batch in batches:
            d, z = projected(_integers(batch.column("vector"), width, scale))
            row, m = np.repeat(np.arange(len(d)), kept_axes), len(d)
            repeated = lambda v, t: pa.array([v] * (m * kept_axes), t)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, kept_axes + 1, dtype=np.int32), m)),
                repeated(n, pa.int64()), _deviations(d).take(pa.array(row)),
                pa.array(z.ravel(), mask=np.tile(~real, m)), pa.array(explained * m, pa.float64()),
                repeated(error, pa.float64())], [c.split()[0] for c in RESULT.split(", ")])
    return kept.mapInArrow(result, RESULT)
