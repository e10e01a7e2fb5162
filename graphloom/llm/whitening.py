"""Embedding whitening by principal components that contour integration finds.

Spark does all that grows with the rows: distinct vectors by a map-side combined grouping of their packed entries,
exact whole-number sums of entries and of products of centred entries, the covariance of the whitened rows, and the
projection of every row.  Sums are whole numbers in every task and are added up in a tree, so results do not depend on
how rows are spread.  What is left on the driver is one matrix of dimension by dimension.

Its leading eigenpairs come from FEAST: inertia counts of the shifted matrix (negative pivots of its tridiagonal form)
place intervals in gaps of the spectrum; quadrature of complex shifted solves along a circle around each projects a
block of vectors onto the interval's invariant subspace; Rayleigh-Ritz extracts the pairs; and the inertia counts at
the interval's ends must equal the number found, so none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import byte_view, discard, read, stored

SCALE = 64
#: Entries beyond this cannot become whole numbers of 64 bits.
LIMIT = 2.0**62
EPS = np.finfo(float).eps
#: Products of whitened values are summed as whole multiples of 2 ** -GRID, which makes the sum independent of its order.
GRID = 24


# --- entries of vectors
def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(64 * entry) of these rows as a matrix) for each length of vector; rows that do not count are left out."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(values * SCALE)
        good = np.abs(y) < LIMIT
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(~good)])
    fine = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    for d in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == d))
        yield rows, y[(ends[rows] - d)[:, None] + np.arange(d)].astype(np.int64)


def packed(y: np.ndarray) -> list[tuple[np.ndarray, pa.Array]]:
    """(rows, bytes) of the rows of ``y``, each in the least of four widths that holds it; equal rows are equal bytes."""
    span = np.maximum(y.max(1), -1 - y.min(1))
    width = np.select([span < 1 << 7, span < 1 << 15, span < 1 << 31], [1, 2, 4], 8)
    out = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data = np.ascontiguousarray(y[rows].astype(f"<i{w}"))
        ends = np.arange(len(rows) + 1, dtype=np.int64) * (w * y.shape[1])
        out.append((rows, pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())))
    return out


def unpacked(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Matrices of the packed rows of one length."""
    data, offsets = byte_view(column)
    size = np.diff(offsets)
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        if len(rows) == len(size):
            raw = data[offsets[0] : offsets[-1]]
        else:
            raw = data[offsets[rows][:, None] + np.arange(s)].ravel()
        yield np.frombuffer(raw.tobytes(), f"<i{s // d}").reshape(-1, d).astype(np.int64)


# --- exact sums
def total(parts: DataFrame) -> list[int] | None:
    """Element-wise sum of rows ``v`` of whole numbers written out in text, in a tree of about the square root's width; None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for v in batch.column("v"):
                row = [int(x) for x in v.as_py().split(" ")]
                out = row if out is None else [a + b for a, b in zip(out, row, strict=True)]
        if out is not None:
            yield pa.RecordBatch.from_pydict({"v": [" ".join(map(str, out))]})

    # At most one row a task comes in, and these are written out: later steps never touch the vectors again.
    kept = stored(parts, "sums")
    n = kept.count()
    width = math.ceil(math.sqrt(n))
    out = kept.repartition(width).mapInArrow(add, "v string") if width > 1 else kept
    rows = out.repartition(1).mapInArrow(add, "v string").collect() if n else []
    discard(kept)
    return [int(x) for x in rows[0]["v"].split(" ")] if rows else None


def exact_products(x: np.ndarray) -> np.ndarray:
    """Sums of products of every two columns (upper triangle), as whole numbers without rounding."""
    upper = np.triu_indices(x.shape[1])
    top = max(1, int(x.max()), -int(x.min()))
    step = (1 << 53) // (top * top)
    if step < 64:
        wide = x.astype(object)
        return (wide.T @ wide)[upper]
    out = np.zeros(len(upper[0]), object)
    for k in range(0, len(x), step):
        part = x[k : k + step].astype(np.float64)
        out += (part.T @ part)[upper].astype(np.int64)
    return out


def sums_of(fit: DataFrame, d: int, row, length: int) -> list[int] | None:
    """``row`` turns a matrix of entries into ``length`` whole numbers; their sum over all distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, any_row = np.zeros(length, object), False
        for batch in batches:
            for y in unpacked(batch.column("x"), d) if batch.num_rows else ():
                out, any_row = out + row(y), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"v": [" ".join(str(int(x)) for x in out)]})

    return total(fit.select("x").mapInArrow(run, "v string"))


# --- eigenpairs
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix with the inertia of every shift of ``a`` (Householder reflections)."""
    a = a.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x / size
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(v, v @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_below(diag: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues are less than each shift, the number of negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / EPS
    q = diag[0] - shifts
    n = (q < 0).astype(np.int64)
    for k in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[k] - shifts - off[k - 1] ** 2 / q
        n += q < 0
    return n


def bisected(diag: np.ndarray, off: np.ndarray, k: int, steps: int = 60) -> np.ndarray:
    """The k greatest eigenvalues, falling, to working precision by inertia counts."""
    reach = np.abs(diag) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, -reach.max()), np.full(k, reach.max() * (1 + 4 * EPS) + np.finfo(float).tiny)
    want = len(diag) - np.arange(1, k + 1)
    for _ in range(steps):
        mid = (low + high) / 2
        under = count_below(diag, off, mid) > want
        low, high = np.where(under, low, mid), np.where(under, mid, high)
    return (low + high) / 2


def intervals(levels: np.ndarray, k: int, scale: float, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, number inside) of intervals that hold the first k of the falling ``levels``.

    Levels that cannot be told apart stay together.  An interval takes as many others, ``most`` at best, as leaves gaps
    of a quarter of its width at both ends, on which the speed of the projection depends.
    """
    gap = 1e-9 * scale
    gaps = np.append(-np.diff(levels), np.inf)
    ends = np.flatnonzero(gaps > gap) + 1
    cuts, start, above = [], 0, np.inf
    while start < k:
        ahead = [int(b) for b in ends[ends > start] if b <= start + most and (b <= k or start < k <= b)] or [int(ends[ends > start][0])]
        wide = [b for b in ahead if 4 * min(gaps[b - 1], above) >= levels[start] - levels[b - 1]] or ahead[:1]
        cuts.append((start, wide[-1]))
        start, above = wide[-1], gaps[wide[-1] - 1]
    out = []
    for a, b in cuts:
        # A circle no wider than its levels and gaps ask for: what lies just outside must be far in its own measure.
        above = (levels[a - 1] - levels[a]) / 2 if a else np.inf
        below = (levels[b - 1] - levels[b]) / 2 if b < len(levels) else np.inf
        wide = max(levels[a] - levels[b - 1], gap)
        sides = [min(mine, max(wide, other if np.isfinite(other) else 0.05 * scale)) for mine, other in ((above, below), (below, above))]
        out.append((levels[b - 1] - sides[1], levels[a] + sides[0], b - a))
    return out


def feast(v: np.ndarray, low: float, high: float, m: int, scale: float, nodes: int = 8, rounds: int = 40, seed: int = 1) -> np.ndarray:
    """Orthonormal columns that span the m eigenvectors of eigenvalues between ``low`` and ``high``.

    Raises unless as many Ritz pairs as the inertia count ``m`` lie inside with a residual of working precision.
    """
    d = len(v)
    size = min(d, m + max(2, m // 2) + 2)
    y = np.random.default_rng(seed).standard_normal((d, size))
    place, weight = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (1 - place))
    best, found, stale = np.inf, None, 0
    for _ in range(rounds):
        q = np.zeros((d, size))
        for w, t in zip(weight, turn, strict=True):
            q += 0.5 * w * np.real(radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y))
        q = np.linalg.qr(q)[0]
        ritz, u = np.linalg.eigh(q.T @ v @ q)
        y = q @ u
        # Mixtures of what lies on both sides may give a Ritz value inside as well, but no small residual.
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        if len(inside) >= m:
            miss = np.abs(v @ y[:, inside] - y[:, inside] * ritz[inside]).max(0)
            chosen = np.sort(inside[np.argsort(miss, kind="stable")[:m]])
            x, residual = y[:, chosen], float(np.sort(miss)[m - 1])
            stale = 0 if residual < best / 2 else stale + 1
            if residual < best:
                best, found = residual, x
            if stale >= 4 and best <= 64 * EPS * scale:
                return found
            if residual <= 2 * EPS * scale:
                return x
    raise ArithmeticError(f"{m} eigenvalues lie between {low} and {high} by inertia; residual {best} after {rounds} rounds")


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k greatest eigenvalues that differ from 0, falling; the largest entry of a vector is positive."""
    scale = float(np.abs(v).sum(1).max()) if len(v) else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    v = v / scale
    diag, off = tridiagonal(v)
    levels = bisected(diag, off, len(v))
    k = min(k, int((levels > 8 * len(v) * EPS).sum()))
    blocks = []
    for low, high, m in intervals(levels, k, 1.0):
        inertia = count_below(diag, off, np.array([low, high]))
        if inertia[1] - inertia[0] != m:
            raise ArithmeticError("interval ends do not agree with their inertia counts")
        blocks.append(feast(v, low, high, m, 1.0))
    q = np.linalg.qr(np.hstack(blocks))[0]
    ritz, u = np.linalg.eigh(q.T @ v @ q)
    x = (q @ u)[:, ::-1][:, :k]
    x /= np.linalg.norm(x, axis=0)
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(k)])
    return ritz[::-1][:k] * scale, x


# --- the operator
@dataclass
class Whitening:
    """A fitted whitening: of ``n`` distinct vectors with sums ``sums`` (of floor(64 c)), components as columns."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = math.nan

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * y - sums as whole numbers (Python's own where 64 bits may not do), and the same over n."""
        mid = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = [s - self.n * int(c) for s, c in zip(self.sums, mid, strict=True)]
        x = y - mid
        if self.n * (max(1, int(x.max()), -int(x.min())) + 1) >= 1 << 62:
            whole = x.astype(object) * self.n - np.array(rest, object)
            return whole, (whole / self.n).astype(np.float64)
        whole = x * self.n - np.array(rest, np.int64)
        return whole, whole / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows.  Dimensions are added in order, so a row's values do not depend on its neighbours."""
        weights = self.components / np.sqrt(self.values)
        out = np.zeros((len(centred), weights.shape[1]))
        for k in range(self.d):
            out += centred[:, k : k + 1] * weights[k]
        return out

    def deviation(self, whole: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; null where it does not fit 64 bits."""
        top = max(1, int(whole.max()), -int(whole.min()))
        if self.d * top * top < 1 << 63:
            whole = whole.astype(np.int64)
            return (whole * whole).sum(1).tolist()
        sums = (whole.astype(object) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of a table; None if no row counts.

    Rows whose vector is null or empty, or holds a null, a non-finite entry or one that does not become a whole number
    of 64 bits, do not count, and neither do vectors of another length than the most frequent one among the distinct
    vectors (of two the longer).  Components whose eigenvalue is 0 (below 8 d eps of the matrix's norm) do not exist.
    Runs jobs: four passes over the distinct vectors, which are stored packed for as long.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y in entries(batch.column("v")):
                for rows, x in packed(y):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), y.shape[1], np.int32)), x], ["d", "x"])

    every = vectors.select(F.col(f"`{vector_col}`").alias("v")).filter("v is not null")
    distinct = stored(every.mapInArrow(pack, "d int, x binary").distinct(), "distinct-vectors")
    most = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        discard(distinct)
        return None
    d = most["d"]
    some = distinct.filter(F.col("d") == d)
    n, *sums = sums_of(some, d, lambda y: np.array([len(y), *(int(s) for s in _column_sums(y))], object), d + 1)
    mid = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    products = sums_of(some, d, lambda y: exact_products(y - mid), d * (d + 1) // 2)
    rest = [s - n * int(c) for s, c in zip(sums, mid, strict=True)]
    v = np.zeros((d, d))
    for (i, j), p in zip(zip(*np.triu_indices(d), strict=True), products, strict=True):
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    values, vectors_ = eigenpairs(v, components)
    out = Whitening(d, n, sums, values, vectors_, float(np.trace(v)))
    if len(values):
        out.identity_error = _identity_error(some, out)
    discard(distinct)
    return out


def _column_sums(y: np.ndarray) -> np.ndarray:
    top = max(1, int(y.max()), -int(y.min()))
    return y.sum(0) if top * len(y) < 1 << 62 else y.astype(object).sum(0)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened distinct vectors' covariance minus the identity."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def row(y: np.ndarray) -> np.ndarray:
        w = model.project(model.centred(y)[1])
        grid = [np.rint(w * 2.0**GRID).astype(np.int64).sum(0)]
        grid += [np.rint(w[:, i : i + 1] * w[:, i:] * 2.0**GRID).astype(np.int64).sum(0) for i in range(k)]
        return np.concatenate(grid).astype(object)

    found = [x / (model.n << GRID) for x in sums_of(distinct, model.d, row, k + len(upper[0]))]
    mean = np.array(found[:k])
    return float(np.abs(np.array(found[k:]) - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max())


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): for each row that counts, its exact squared deviation sum and its whitened vector.

    ``deviation`` is the sum over dimensions of (n * x - S) squared.  Ids may be null or repeat; each row stands for itself.
    """
    d = model.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in entries(batch.column("v")):
                if y.shape[1] != d:
                    continue
                whole, centred = model.centred(y)
                w = model.project(centred)
                flat = pa.array(w.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(model.deviation(whole), pa.int64()), lists], ["id", "deviation", "whitened"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter("v is not null")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
