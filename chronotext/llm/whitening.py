"""Operator 11, whitening of embeddings by a compensated covariance and a divide-and-conquer eigen-solve.

Entries become whole numbers x = floor(scale * c). The statistics are those of the fit list, which has each distinct x vector
once: exact sums, then outer products of the vectors less the mean, in double-double. A block's products are exact: its
entries are split into slices of so few bits that no sum of their products rounds (an error-free transformation of the
matrix product), and what the slices' sums add up to goes into a high and a low part by two-sum. Tasks send a row for each dimension, and
high and low parts are merged dimension by dimension in two rounds. The driver gets one such matrix of (dimensions x dimensions).

The eigen-solve takes the matrix to tridiagonal form by reflections, tears it in two, and joins the halves by the roots of the
secular equation (deflated where an entry is negligible, roots by bisection from the nearer pole, vectors from the weights for which those roots
are exact). Refinement with residuals in double-double, mostly one or two steps, brings the vectors to double precision.

Rows whose vector is null, empty, or holds a null, NaN or infinite entry are left out; so are rows whose vector has not the most frequent width (of
equally frequent ones the largest). x is held within 2**62 on either side. Repeated rows are each returned and fitted once; a null id is
returned like any other; columns other than the id and the vector are not read; an empty table gives no rows. A component
without variance (an eigenvalue of nothing but rounding) has null ``whitened`` and ``explained``; where no component has any, ``identity_error`` is null.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

SCALE = 256
COMPONENTS = 4
#: Rows of a block whose products are summed exactly.
BLOCK = 1024
#: Parts of a matrix row merged at once in the first round.
MERGED = 256
_EPS = np.finfo(float).eps

Pair = tuple[np.ndarray, np.ndarray]  # a high part and a low part


# ---- error-free arithmetic ----


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def slices(a: np.ndarray, axis: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Three slices of a, each of at most `bits` bits below the largest entry along the axis, and what they leave."""
    out = []
    top = np.max(np.abs(a), axis=axis, keepdims=True, initial=0)
    step = np.exp2(np.frexp(np.where(top > 0, top, 1.0))[1] - bits)
    for _ in range(3):
        shift = 1.5 * 2.0**52 * step  # adding it rounds to a multiple of step
        out.append((a + shift) - shift)
        a = a - out[-1]
        step = step * 2.0 ** -(bits + 1)
    return out, a


def product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a @ b in double-double: the slices' products are exact, so only what the slices leave is rounded."""
    bits = (52 - max(1, a.shape[1]).bit_length()) // 2
    (sa, ra), (sb, rb) = slices(a, 1, bits), slices(b, 0, bits)
    total = (np.zeros((a.shape[0], b.shape[1])), ra @ b + (a - ra) @ rb)
    for x, y in sorted(((x, y) for x in range(3) for y in range(3)), key=sum):
        total = add(total, (sa[x] @ sb[y], np.zeros_like(total[0])))
    return total


def over(a: Pair, n: int) -> Pair:
    """a / n in double-double."""
    q = a[0] / n
    back = product(q.reshape(-1, 1), np.array([[float(n)]]))
    rest = add(a, (-back[0].reshape(q.shape), -back[1].reshape(q.shape)))
    return two_sum(q, (rest[0] + rest[1]) / n)


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """Whole numbers less the mean."""
    high = x.astype(float)
    low = (x - high.astype(np.int64)).astype(float)
    s, e = two_sum(high, -mean[0])
    return two_sum(s, e + (low - mean[1]))


# ---- eigen-solve ----


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q T q' by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not (norm := math.sqrt(v @ v)):
            continue
        v[0] += math.copysign(norm, v[0])
        v /= math.sqrt(v @ v)
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        p -= (p @ v) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, p) + np.outer(p, v)
        a[k + 1, k] = -math.copysign(norm, a[k + 1, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + rho z z' for ascending distinct d, z without zeros and rho > 0: a root lies right of each d. It is counted from its nearer
    pole, so differences of roots and poles lose no digits; bisection runs on the logarithm of that distance, then on the distance itself."""
    n, z2 = len(d), z * z
    right = np.append(d[1:], d[-1] + rho * z2.sum())
    value = lambda origin, mu: 1 + rho * (z2 / ((d[None, :] - origin[:, None]) - mu[:, None])).sum(1)
    half = (right - d) / 2
    left = value(d, half) >= 0  # grows from pole to pole
    left[-1] = True
    origin = np.where(left, d, right)
    sign = np.where(left, 1.0, -1.0)
    most = np.where(np.arange(n) == n - 1, right - d, half)
    high = np.log(most)
    low = high - 160.0  # deflation keeps roots further off their poles
    for _ in range(64):
        mid = (low + high) / 2
        beyond = value(origin, sign * np.exp(mid)) * sign >= 0
        low, high = np.where(beyond, low, mid), np.where(beyond, mid, high)
    mu = np.exp((low + high) / 2)
    low, high = mu * (1 - 1e-11), np.minimum(mu * (1 + 1e-11), most)
    for _ in range(24):
        mid = (low + high) / 2
        beyond = value(origin, sign * mid) * sign >= 0
        low, high = np.where(beyond, low, mid), np.where(beyond, mid, high)
    mu = sign * (low + high) / 2
    gap = (origin[None, :] - d[:, None]) + mu[None, :]  # root j less pole i
    poles = d[None, :] - d[:, None]
    ratio = np.empty((n, n))
    i, j = np.tril_indices(n, -1)
    ratio[i, j] = gap[i, j] / poles[i, j]
    i, j = np.triu_indices(n)
    ratio[i, j] = gap[i, j] / np.where(j < n - 1, poles[i, np.minimum(j + 1, n - 1)], rho)
    own = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), z)
    vectors = own[:, None] / -gap
    return origin + mu, vectors / np.sqrt((vectors * vectors).sum(0))


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors of a symmetric tridiagonal matrix."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m = n // 2
    rho = abs(e[m - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (d1, q1), (d2, q2) = divide(upper, e[: m - 1]), divide(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values = np.concatenate([d1, d2])
    z = np.concatenate([q1[-1], math.copysign(1.0, e[m - 1]) * q2[0]])
    order = np.argsort(values, kind="stable")
    values, z, q = values[order], z[order], q[:, order]
    small = 8 * _EPS * max(np.abs(values).max(), rho * (z @ z))
    kept: list[int] = []
    for i in range(n):  # deflation: what hardly moves, and of equal values all but one
        if rho * abs(z[i]) <= small:
            z[i] = 0.0
            continue
        if kept and values[i] - values[p := kept[-1]] <= small:
            r = math.hypot(z[p], z[i])
            c, s = z[i] / r, z[p] / r
            q[:, [p, i]] = np.stack([c * q[:, p] - s * q[:, i], s * q[:, p] + c * q[:, i]], 1)
            values[p], values[i] = values[p] * c * c + values[i] * s * s, values[p] * s * s + values[i] * c * c
            z[p], z[i] = 0.0, r
            kept.pop()
        kept.append(i)
    if kept:
        values[kept], v = secular(values[kept], z[kept], rho)
        q[:, kept] = q[:, kept] @ v
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


def refined(a: Pair, q: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors after steps of refinement with residuals in double-double, until a step is small; what a step leaves is its square."""
    n = len(q)
    for _ in range(rounds):
        gram = product(q.T, q)
        r = add((np.eye(n), np.zeros((n, n))), (-gram[0], -gram[1]))[0]
        aq = product(a[0], q)
        aq = add(aq, (a[1] @ q, np.zeros((n, n))))
        s = add(product(q.T, aq[0]), (q.T @ aq[1], np.zeros((n, n))))
        values = np.diag(s[0]) / (1 - np.diag(r)) + np.diag(s[1])
        rest = s[0] + s[1] - np.diag(values)
        near = 2 * (np.linalg.norm(rest) + np.linalg.norm(a[0]) * np.linalg.norm(r))
        apart = values[None, :] - values[:, None]
        turn = rest + np.diag(values) + values[None, :] * r
        far = np.abs(apart) > np.maximum(near, 1e3 * np.abs(turn))  # nearer values share a plane in which any basis will do
        step = np.where(far, turn / np.where(far, apart, 1.0), r / 2)
        q = q + q @ step
        if np.abs(step).max() < 1e-10:
            break
    return values, q


def eigen(a: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues, and unit vectors as columns whose largest entry is positive."""
    scale = np.abs(a[0]).max()
    if not scale:
        return np.zeros(len(a[0])), np.eye(len(a[0]))
    power = 2.0 ** math.frexp(scale)[1]
    a = (a[0] / power, a[1] / power)
    d, e, q = tridiagonal(a[0])
    values, vectors = refined(a, q @ divide(d, e)[1])
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(vectors))])
    return values[order] * power, vectors


# ---- Spark ----


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x, width of the rows whose vector is whole and finite."""
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-(1 << 62))), F.lit(1 << 62)))
    return vectors.where(v.isNotNull()).where(whole).select(F.col(id_col).alias("vec_id"), x.alias("x")).withColumn("width", F.size("x"))


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension)."""

    def run(batches):
        n, total = 0, [0] * width
        for b in batches:
            x = _matrix(b.column(0), width)
            n += len(x)
            total = [t + (h << 32) + low for t, h, low in zip(total, (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], ["dim", "total"])

    got = dict(fit.select("x").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)")).collect())  # a row for each dimension
    return int(got.get(-1, 0)), [int(got.get(k, 0)) for k in range(width)]


def mean_of(n: int, total: list[int]) -> Pair:
    exact = [Fraction(t, n) for t in total]
    high = np.array([float(m) for m in exact])
    return high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high.tolist(), strict=True)])


def covariance(fit: DataFrame, width: int, n: int, mean: Pair) -> Pair:
    """Outer products of the centred rows, summed in double-double and divided by n."""

    def run(batches):
        total = (np.zeros((width, width)), np.zeros((width, width)))
        for b in batches:
            x = _matrix(b.column(0), width)
            for k in range(0, len(x), BLOCK):
                high, low = centred(x[k : k + BLOCK], mean)
                cross = high.T @ low
                total = add(total, add(product(np.ascontiguousarray(high.T), high), (cross + cross.T, np.zeros_like(cross))))
        yield sent(range(width), TaskContext.get().partitionId(), *total)

    names = ["dim", "part", "high", "low"]

    def sent(dims, part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        rows = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([part] * len(high), pa.int32()), rows(high), rows(low)], names)

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("part").combine_chunks()
        high, low = (np.asarray(group[c].combine_chunks().flatten()).reshape(-1, width) for c in ("high", "low"))
        total = (high[0], low[0])
        for k in range(1, len(high)):
            total = add(total, (high[k], low[k]))
        return pa.Table.from_batches([sent([group["dim"][0].as_py()], group["part"][0].as_py() // MERGED, total[0][None], total[1][None])])

    schema = "dim int, part int, high array<double>, low array<double>"
    parts = fit.select("x").mapInArrow(run, schema)
    parts = parts.groupBy("dim", F.floor(F.col("part") / MERGED)).applyInArrow(lambda key, t: merge(t), schema)
    rows = sorted(parts.groupBy("dim").applyInArrow(lambda key, t: merge(t), schema).collect())  # a row for each dimension
    return over((np.array([r.high for r in rows]), np.array([r.low for r in rows])), n)


def identity_error(fit: DataFrame, width: int, n: int, mean: Pair, weights: np.ndarray) -> float | None:
    """The largest entry of the covariance of the whitened fit list less the identity."""
    k = weights.shape[1]
    if not k:
        return None

    def run(batches):
        total = np.zeros((k + 1) * k)
        for b in batches:
            high, low = centred(_matrix(b.column(0), width), mean)
            y = high @ weights + low @ weights
            total += np.concatenate([y.sum(0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "total"])

    got = dict(fit.select("x").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect())  # (components + 1) x components rows
    first, second = (np.array([got[i] for i in range(a, b)]) / n for a, b in ((0, k), (k, (k + 1) * k)))
    return float(np.abs(second.reshape(k, k) - np.outer(first, first) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - total)^2, exact; null beyond 38 digits."""
    top = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, total))
    if top < 1 << 62:
        u = np.abs(n * x - np.array(total, np.int64))
        a, b, c = u >> 42, (u >> 21) & 0x1FFFFF, u & 0x1FFFFF
        parts = [(p.sum(1)).tolist() for p in (a * a, 2 * a * b, 2 * a * c + b * b, 2 * b * c, c * c)]
        found = [(p << 84) + (q << 63) + (r << 42) + (s << 21) + t for p, q, r, s, t in zip(*parts, strict=True)]
    else:
        found = [sum((n * v - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling variance), n (distinct vectors), deviation, whitened, explained,
    identity_error."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = quantised(vectors, scale, id_col, vector_col)
    fit = materialize(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("width", F.size("x")), "distinct_vectors")
    widest = fit.groupBy("width").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    if widest is None:
        return spark.createDataFrame([], schema)
    width = widest["width"]
    own = fit.where(F.col("width") == width)
    n, total = sums(own, width)
    mean = mean_of(n, total)
    cov = covariance(own, width, n, mean)
    values, basis = eigen(cov)
    there = [k for k in range(min(components, width)) if values[k] > 4 * width * _EPS * max(values[0], 0)]
    weights = basis[:, there] / np.sqrt(values[there])
    error = identity_error(own, width, n, mean, weights)
    release(fit)
    k, share = min(components, width), [float(values[c] / np.trace(cov[0])) if c in there else None for c in range(min(components, width))]

    def project(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            if not len(x):
                continue
            high, low = centred(x, mean)
            y = np.full((len(x), k), np.nan)
            y[:, there] = high @ weights + low @ weights
            row, of = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(of + 1, pa.int32()), pa.array(np.full(len(row), n)), deviations(x, n, total).take(pa.array(row)), pa.array(y.ravel(), from_pandas=True), pa.array(share, pa.float64()).take(pa.array(of)), pa.array([error] * len(row), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.col("width") == width).select("vec_id", "x").mapInArrow(project, schema)


def op11_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
