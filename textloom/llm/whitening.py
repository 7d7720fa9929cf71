"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers, so means are exact fractions. Centred outer products are taken without error (each product
and each sum as a rounded value and what rounding lost) and summed as pairs of doubles, within tasks and across them. The
covariance's eigenvectors come from a reduction to tridiagonal form that is split in halves, whose solutions are joined by
the roots of a secular equation, and are then refined against both parts of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, tidy

COMPONENTS = 4
#: Entries are multiplied by this and rounded down; results beyond ``LARGEST`` on either side become ``LARGEST``.
SCALE, LARGEST = 256.0, float(1 << 53)
#: Of a component's share of the variance, what counts as none.
NONE = 1e-13
#: Numbers of a block of outer products.
BLOCK = 1 << 17
#: Groups in which tasks' sums meet before they meet in one.
GROUPS = 16

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b):
    """The rounded sum and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a):
    t = a * 134217729.0  # 2^27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """The rounded product and what rounding lost."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs (high, low), to about 106 bits."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def total(a: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = a
    while len(high) > 1:
        n = len(high) // 2
        odd = (high[2 * n :], low[2 * n :])
        high, low = add((high[:n], low[:n]), (high[n : 2 * n], low[n : 2 * n]))
        high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return high[0], low[0]


def split(x: Fraction) -> tuple[float, float]:
    return float(x), float(x - Fraction(float(x)))


def finite_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor empty and has no entry that is null or not finite."""
    c = F.col("embedding").cast("array<double>")
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    number = lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * SCALE)))
    return embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, number).alias("x"))


def _matrix(b: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows of ``fit`` (x) and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, 0, width)
            high = x >> 26  # so that no sum of a batch leaves 64 bits
            yield pa.RecordBatch.from_pydict({"dim": np.arange(width), "high": high.sum(0), "low": (x - (high << 26)).sum(0), "n": np.full(width, len(x))})

    rows = fit.select("x").mapInArrow(run, "dim long, high long, low long, n long")
    got = rows.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).collect()  # one row a dimension
    found = {r.dim: (int(r.high) << 26) + int(r.low) for r in got}
    return (int(got[0].n), [found[k] for k in range(width)]) if got else (0, [])


def covariance(fit: DataFrame, n: int, s: list[int]) -> Pair:
    """High and low parts of the covariance (divisor n) of the rows of ``fit`` (x)."""
    width = len(s)
    mean = np.array([split(Fraction(v, n)) for v in s]).T
    upper = np.triu_indices(width)
    rows = max(1, BLOCK // len(upper[0]))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(len(upper[0])), np.zeros(len(upper[0]))
        for b in batches:
            x = _matrix(b, 0, width).astype(np.float64)
            for at in range(0, len(x), rows):
                high, low = two_sum(x[at : at + rows], -mean[0])
                high, low = two_sum(high, low - mean[1])
                left, right = ((high[:, k], low[:, k]) for k in upper)
                acc = add(acc, total(multiply(left, right)))
        start = np.concatenate([[0], np.cumsum(np.arange(width, 0, -1))])
        lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(a)) for a in acc]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *lists], names=["dim", "high", "low"])

    def merged(group: pa.Table) -> pa.Table:
        high, low = total(tuple(np.stack([np.asarray(v) for v in group.column(c).to_pylist()]) for c in ("high", "low")))
        return pa.table({"dim": group.column("dim")[:1], "high": [high], "low": [low]})

    schema = "dim int, high array<double>, low array<double>"
    parts = fit.select("x").mapInArrow(tidy(outer), schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = parts.groupBy("dim", "group").applyInArrow(merged, schema).groupBy("dim").applyInArrow(merged, schema)
    out = np.zeros((2, width, width))
    for r in some.collect():  # the square of the dimension
        out[0, r.dim, r.dim :] = out[0, r.dim :, r.dim] = r.high
        out[1, r.dim, r.dim :] = out[1, r.dim :, r.dim] = r.low
    high = out[0] / n
    p, e = two_product(high, float(n))
    return two_sum(high, ((out[0] - p) - e + out[1]) / n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and orthogonal q with a = q t q^T, by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        for m in (a[k + 1 :], q.T[k + 1 :]):
            m -= 2 * np.outer(v, v @ m)
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _updated(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z^T for rho > 0. Entries of z that are too small to matter, and one of
    each two that belong to equal entries of d, are set aside first."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, turned = d[order], z[order].copy(), np.eye(n)[:, order]
    tiny = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * float(z @ z))
    alive = rho * np.abs(z) * np.linalg.norm(z) > tiny
    last = -1
    for k in np.flatnonzero(alive):
        if last >= 0 and d[k] - d[last] <= tiny:  # turn the pair so that the earlier entry vanishes
            r = np.hypot(z[last], z[k])
            c, s = z[k] / r, z[last] / r
            turned[:, [last, k]] = turned[:, [last, k]] @ np.array([[c, s], [-s, c]])
            z[last], z[k], alive[last] = 0.0, r, False
        last = k
    values, vectors = d.copy(), turned.copy()
    at = np.flatnonzero(alive)
    if not len(at):
        return values, vectors
    p, w = d[at], z[at] ** 2
    gap = np.diff(p, append=p[-1] + rho * w.sum())
    top = p + gap
    # Each root is sought from the pole that is nearer, so that its distance from all poles keeps its leading digits.
    middle = gap / 2
    at_middle = 1 + rho * (w / (p[None] - p[:, None] - middle[:, None])).sum(1)
    right = (at_middle < 0) & (np.arange(len(p)) < len(p) - 1)
    base = np.where(right, top, p)
    shift = p[None] - base[:, None]
    shift[np.arange(len(p) - 1)[right[:-1]], np.arange(1, len(p))[right[:-1]]] = 0.0
    low, high = np.where(right, -middle, 0.0), np.where(right, 0.0, np.where(np.arange(len(p)) == len(p) - 1, gap, middle))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            mu = (low + high) / 2
            below = 1 + rho * (w / (shift - mu[:, None])).sum(1) < 0
            low, high = np.where(below, mu, low), np.where(below, high, mu)
    # the half of the interval that does not touch the pole
    mu = np.where(right, low, high)
    apart = shift - mu[:, None]  # [root, pole]: pole less root
    # The z of which these roots are exact; vectors made from it are orthogonal.
    square = np.ones(len(p))
    for i in range(len(p)):
        others = np.arange(len(p)) != i
        near = np.where(np.arange(len(p)) < i, np.arange(len(p)), np.arange(len(p)) - 1)
        square[i] = np.prod(apart[near[others], i] / (p[i] - p[others])) * -apart[-1, i] / rho
    y = np.sqrt(np.abs(square)) * np.sign(z[at])
    u = y[None] / apart
    u /= np.linalg.norm(u, axis=1)[:, None]
    values[at], vectors[:, at] = base + mu, turned[:, at] @ u.T
    return values, vectors


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the symmetric tridiagonal matrix with diagonal d and side diagonal e."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m, rho = n // 2, e[n // 2 - 1]
    left, right = d[:m].copy(), d[m:].copy()
    left[-1] -= rho
    right[0] -= rho
    (a, qa), (b, qb) = divide(left, e[: m - 1]), divide(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = qa, qb
    if rho == 0:
        return np.concatenate([a, b]), q
    z, sign = np.concatenate([qa[-1], qb[0]]), np.sign(rho)
    values, vectors = _updated(sign * np.concatenate([a, b]), z, abs(rho))
    return sign * values, q @ vectors


def refined(v: Pair, q: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of high + low, from approximate vectors, in the longest floats there are."""
    a, x = v[0].astype(np.longdouble) + v[1], q.astype(np.longdouble)
    for _ in range(rounds):
        r, s = np.eye(len(x)) - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        far = values[None] - values[:, None]
        limit = 2 * (np.abs(s - np.diag(values)).max() + np.abs(values).max() * np.abs(r).max()) * len(x)
        apart = np.abs(far) > limit
        x = x + x @ np.where(apart, (s + values[None] * r) / np.where(apart, far, 1), r / 2)
    return values, x


def eigen(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns of the symmetric matrix high + low."""
    scale = float(np.abs(v[0]).max()) or 1.0
    d, e, q = tridiagonal(v[0] / scale)
    values, vectors = refined((v[0] / scale, v[1] / scale), q @ divide(d, e)[1])
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(0))
    return values[order].astype(np.float64) * scale, vectors.astype(np.float64)


class Whitener:
    """Number, sums, and the leading components with their eigenvalues."""

    def __init__(self, n: int, s: list[int], v: Pair, components: int) -> None:
        self.n, self.s = n, s
        values, vectors = eigen(v)
        self.values, self.vectors = values[:components], vectors[:, :components]
        whole = float(np.trace(v[0]))
        self.explained = self.values / whole if whole > 0 else np.zeros(len(self.values))
        self.some = self.explained > NONE

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit integers where they and the sum of their squares fit, else Python's."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.s), default=0)
        kind = np.int64 if reach**2 * x.shape[1] < 1 << 63 else object
        return x.astype(kind) * self.n - np.array(self.s, kind)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """From deviations; a component without variance gives NaN."""
        root = np.sqrt(np.where(self.some, self.values, np.nan))
        return (d / self.n).astype(np.float64) @ self.vectors / root


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Whitener, float | None] | None:
    """Components of the different vectors of ``rows`` (x), and how far the covariance of what is whitened is from the
    identity; None without rows."""
    distinct = scratch(rows.select("x").distinct(), "vectors")
    n, s = sums(distinct, width)
    if not n:
        return None
    model = Whitener(n, s, covariance(distinct, n, s), components)
    known = rows.sparkSession.sparkContext.broadcast(model)  # a few vectors of the table's width

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = known.value.whitened(known.value.deviations(_matrix(b, 0, width)))
            k = w.shape[1]
            yield pa.RecordBatch.from_pydict({"at": np.arange(k * k), "v": (w.T @ w).ravel()})

    got = distinct.mapInArrow(squares, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # components squared
    k = len(model.values)
    error = np.full(k * k, np.nan)
    for r in got:
        error[r["at"]] = abs(r.v / n - (r["at"] % (k + 1) == 0))
    return model, float(np.nanmax(error)) if model.some.any() else None


def _width(rows: DataFrame) -> int | None:
    found = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found.width if found else None


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each row of ``embeddings`` (vec_id, embedding) with a usable vector, and each of the leading components:
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or have an entry that is null or not finite, have no rows, nor have those of another
    length than most (of equally frequent lengths the larger counts). Equal vectors are fitted once and all returned; a
    null vec_id stays null, repeated rows are repeated. A component without variance has whitened null; with none that has,
    identity_error is null. A deviation that 64 bits can't hold is null. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = finite_rows(embeddings)
    width = _width(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == width)
    model, error = fit(rows, width, components)
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        k = len(m.values)
        for b in batches:
            d = m.deviations(_matrix(b, 1, width))
            squares = (d * d).sum(1)
            held = pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64()) if d.dtype == object else pa.array(squares)
            each = np.repeat(np.arange(b.num_rows), k)
            columns = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(len(each), m.n)), held.take(pa.array(each))]
            columns += [pa.array(m.whitened(d).ravel(), from_pandas=True), pa.array(np.tile(m.explained, b.num_rows)), pa.array([error] * len(each), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), schema)
