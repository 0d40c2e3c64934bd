"""Embedding whitening by incremental eigendecomposition (operator 11).

Every vector becomes whole numbers, x = floor(scale * c), and each distinct x
counts once in the fit.  A partition of that list takes its vectors one by one:
the scatter about the running mean changes by one rank, so its spectrum is
renewed by the roots of a secular equation, equal eigenvalues and vanishing
weights being deflated first.  Two partitions' spectra are combined by as many
rank-one updates as the second has eigenvalues, and one more for the distance
of the means, in a tree of small groups.  The last basis is refined on all
partitions: Rayleigh-Ritz passes over the list, centred with the exact mean,
go on until what is left beside the diagonal is rounding.

State a task: dims x dims numbers and one Arrow batch.  The driver gets one such
matrix.  A row costs dims ** 3 steps, so the method suits some hundred dims.

Defined results: a null vector, or one with a null, infinite or NaN entry, is
left out.  Vectors whose length isn't the commonest (of several: the least) have
no place in its space and are left out as well.  Entries beyond the range of a
long are set to its ends.  Repeated and null ids give a row each.  A component
needs an eigenvalue above rounding (EIGEN_FLOOR of the trace), so equal vectors,
a single one or an empty table give no row.  A deviation beyond the range of a
long is null.  Other columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, tree_merge

SCALE = 256
COMPONENTS = 4
#: Rows of the fit list for each of its partitions.
ROWS_A_PART = 20_000
#: Share of the trace below which an eigenvalue is rounding.
EIGEN_FLOOR = 1e-13
#: A refinement pass follows while an entry beside the diagonal exceeds this share of the trace.
REFINED, MAX_PASSES = 1e-13, 8
FAN_IN = 8
_LONG = np.iinfo(np.int64)
_EPS = np.finfo(float).eps


# ------------------------------------------------------------ rank-one updates
@np.errstate(all="ignore")  # what isn't finite is caught by the bracket
def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + u u^T with u * u = w, and the matrix d_i - root_j.

    d rises strictly and w > 0.  Root j lies between d_j and d_(j+1); it is
    sought as a distance from the nearer of the two, by the rational
    interpolation through both poles, with the bracket as a safeguard.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    mid = d + gap / 2
    at_mid = 1.0 + (w[:, None] / (d[:, None] - mid[None, :])).sum(0)
    from_left = (at_mid >= 0) | (np.arange(k) == k - 1)
    origin = np.where(from_left, d, right)
    delta = d[:, None] - origin[None, :]
    lo = np.where(from_left, 0.0, -gap / 2)
    hi = np.where(from_left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    lo[-1] = np.where(at_mid[-1] < 0, gap[-1] / 2, 0.0)
    if at_mid[-1] >= 0:
        hi[-1] = gap[-1] / 2
    found = t = (lo + hi) / 2
    at, poles, left, last = np.arange(k), delta, _triangle(k), np.arange(k) == k - 1  # left[i, j]: i <= j, the poles to the left of root j
    pole_a, pole_b = d - origin, right - origin
    for _ in range(64):
        inverse = 1.0 / (poles - t)
        f = 1.0 + w @ inverse
        size = 1.0 + w @ np.abs(inverse)
        up = f > 0
        hi = np.where(up, t, hi)
        lo = np.where(up, lo, t)
        inverse *= inverse
        slope = w @ inverse
        # rounding of f: of its terms, and of t beside the nearest pole
        done = (np.abs(f) <= _EPS * (8 * size + np.abs(t) * slope)) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        open_ = len(done) - np.count_nonzero(done)
        if not open_:
            break
        psi = w @ (inverse * left)
        phi = slope - psi
        a_, b_ = pole_a - t, pole_b - t
        c = f - a_ * psi - b_ * phi
        a = (a_ + b_) * f - a_ * b_ * slope
        b = a_ * b_ * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(last, a_ + slope * a_ * a_ / (f - slope * a_), step)  # one pole only: it is beyond all of them
        new = t + step
        wild = ~np.isfinite(new) | (new <= lo) | (new >= hi)
        t = np.where(done, t, np.where(wild, (lo + hi) / 2, new))
        if 2 * open_ <= len(done):  # go on with the roots that are still sought
            found[at] = t
            go = np.flatnonzero(~done)
            at, t, lo, hi, pole_a, pole_b, last, poles, left = at[go], t[go], lo[go], hi[go], pole_a[go], pole_b[go], last[go], poles[:, go], left[:, go]
    found[at] = t
    return origin + found, delta - found


@lru_cache(maxsize=4096)
def _triangle(k: int) -> np.ndarray:
    return np.ascontiguousarray(np.tri(k).T)


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising d, columns of u) of u diag(d) u^T + rho v v^T, rho >= 0."""
    z = u.T @ v
    weight = rho * float(z @ z)
    tol = 8 * _EPS * max(abs(d[0]), abs(d[-1]), weight)
    if weight <= tol:
        return d, u
    u = u.copy()
    edges = np.flatnonzero(np.diff(d) > tol) + 1
    if len(edges) < len(d) - 1:  # equal eigenvalues: one reflection puts a cluster's whole weight on its last place
        for a, b in zip(np.append(0, edges), np.append(edges, len(d))):
            if b - a > 1 and (size := np.linalg.norm(z[a:b])) > 0:
                side = np.copysign(size, z[b - 1])
                h = z[a:b].copy()
                h[-1] += side
                u[:, a:b] -= np.outer(u[:, a:b] @ h, h) * (2.0 / (h @ h))
                z[a:b] = 0.0
                z[b - 1] = -side
    live = np.flatnonzero(np.sqrt(rho * weight) * np.abs(z) > tol)
    if not len(live):
        return d, u
    dk, zk = d[live], z[live]
    roots, diff = secular_roots(dk, rho * zk * zk)
    k = len(live)
    # the weights for which the roots are exact (Loewner), so that the columns are orthogonal
    gaps = dk[:, None] - dk[None, :]
    under = np.full((k, k), -1.0)
    under[:, :-1] = np.where(_triangle(k)[:, :-1] > 0, gaps[:, 1:], gaps[:, :-1])
    with np.errstate(all="ignore"):
        fit = np.sqrt(np.abs(np.prod(diff / under, axis=1)))
        columns = np.copysign(fit, zk)[:, None] / diff
        columns /= np.linalg.norm(columns, axis=0)
    if k == len(d):
        u, d = u @ columns, roots
    else:
        u[:, live] = u[:, live] @ columns
        d = d.copy()
        d[live] = roots
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


@dataclass
class Spectrum:
    """n vectors with exact sums, their mean, and the spectrum of the scatter about it."""

    n: int
    sums: list[int]
    mean: np.ndarray
    d: np.ndarray
    u: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """One vector more: a centred rank-one update (its exact sum is added by the caller)."""
        away = x - self.mean
        self.d, self.u = rank_one(self.d, self.u, away, self.n / (self.n + 1.0))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        """The other's eigenvectors, each by its eigenvalue, then the distance of the means."""
        if not other.n:
            return
        for value, column in zip(other.d, other.u.T):
            if value > 0:
                self.d, self.u = rank_one(self.d, self.u, column, float(value))
        away, n = other.mean - self.mean, self.n + other.n
        self.d, self.u = rank_one(self.d, self.u, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(), "d": self.d.tolist(), "u": self.u.ravel().tolist()}

    @classmethod
    def of(cls, row) -> Spectrum:
        dims = len(row["d"])
        return cls(int(row["n"]), [int(s) for s in row["sums"]], np.asarray(row["mean"], float), np.asarray(row["d"], float), np.asarray(row["u"], float).reshape(dims, dims))


# ------------------------------------------------------------ whole-number vectors
def pack(x: np.ndarray) -> bytes:
    """One encoding for each vector: 16-bit numbers if all fit, else 64-bit ones."""
    small = not len(x) or (x.min() >= -32768 and x.max() <= 32767)
    return b"h" + x.astype("<i2").tobytes() if small else b"q" + x.astype("<i8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"h" else "<i8", offset=1).astype(np.int64)


def whole_vector(values, scale: int) -> np.ndarray | None:
    """floor(scale * c) of each entry, or None if the vector is null or an entry isn't finite."""
    if values is None:
        return None
    c = np.array([np.nan if v is None else v for v in values], float) if not isinstance(values, np.ndarray) else values.astype(float)
    if not np.isfinite(c).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(c * scale)
    ends = (x >= 2.0**63, x < -(2.0**63))
    return np.where(ends[0], _LONG.max, np.where(ends[1], _LONG.min, np.where(ends[0] | ends[1], 0.0, x).astype(np.int64)))


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id, dims and x (packed) of every vector that is whole and finite; narrow."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = "id long, dims int, x binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for at, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                entries = v.values
                if entries is None or entries.null_count:
                    continue
                x = whole_vector(entries.to_numpy(zero_copy_only=False), scale)
                if x is not None:
                    ids.append(at)
                    dims.append(len(x))
                    packed.append(pack(x))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, dims, packed), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------ fit
@dataclass(frozen=True)
class Whitening:
    """What a fit has found; components are columns, by falling eigenvalue."""

    dims: int
    scale: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


_SPECTRUM = "pid int, n long, sums array<string>, mean array<double>, d array<double>, u array<double>"
_MATRIX = "pid int, g array<double>"


def _partition_spectra(fit: DataFrame, dims: int) -> DataFrame:
    """A spectrum for each partition that has rows."""
    arrow = arrow_schema(_SPECTRUM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = Spectrum.empty(dims), 0
        for batch in batches:
            for pid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = unpack(raw)
                state.add(x.astype(float))
                state.sums = [a + b for a, b in zip(state.sums, x.tolist())]
        if state.n:
            yield pa.RecordBatch.from_pylist([{"pid": pid, **state.row()}], schema=arrow)

    return fit.select("pid", "x").mapInArrow(run, _SPECTRUM)


def _merged_spectra(rows: list[dict]) -> dict:
    state = Spectrum.of(rows[0])
    for row in rows[1:]:
        state.combine(Spectrum.of(row))
    return state.row()


def _projected_scatter(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """basis^T (x - mean)(x - mean)^T basis, summed by partition."""
    arrow = arrow_schema(_MATRIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pid = None, 0
        for batch in batches:
            if batch.num_rows:
                pid = batch.column(0)[0].as_py()
                y = (np.stack([unpack(raw) for raw in batch.column(1).to_pylist()]) - mean) @ basis
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "g": total.ravel().tolist()}], schema=arrow)

    return fit.select("pid", "x").mapInArrow(run, _MATRIX)


def _summed(rows: list[dict]) -> dict:
    return {"g": np.sum([np.asarray(r["g"], float) for r in rows], axis=0).tolist()}


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Fit on each distinct whole-number vector once; None if there is none, or all of them are equal."""
    whole = quantise(vectors, id_col, vec_col, scale)
    distinct = cut(whole.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("copies")))
    lengths = distinct.groupBy("dims").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("rows"), "dims").limit(1).collect()
    if not lengths or not lengths[0]["dims"]:
        return None
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    session = vectors.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_PART))
    fit = cut(distinct.where(F.col("dims") == dims).select("x").repartition(parts, "x").withColumn("pid", F.spark_partition_id()))
    merged = tree_merge(_partition_spectra(fit, dims), _merged_spectra, _SPECTRUM, parts, FAN_IN)
    state = Spectrum.of(merged)
    mean = np.array([s / state.n for s in state.sums])
    basis, _ = np.linalg.qr(state.u[:, ::-1])

    def ritz(b: np.ndarray) -> np.ndarray:
        g = tree_merge(_projected_scatter(fit, mean, b), _summed, _MATRIX, fit.rdd.getNumPartitions(), FAN_IN)
        m = np.asarray(g["g"], float).reshape(dims, dims) / state.n
        return (m + m.T) / 2

    g = ritz(basis)
    trace = float(np.trace(g))
    if trace <= 0:
        return None
    for _ in range(MAX_PASSES):
        _, turn = np.linalg.eigh(g)
        basis, _ = np.linalg.qr(basis @ turn[:, ::-1])
        g = ritz(basis)
        if np.abs(g - np.diag(np.diag(g))).max() <= REFINED * trace:
            break
    values = np.diag(g)
    order = np.argsort(-values, kind="stable")
    keep = [i for i in order if values[i] > EIGEN_FLOOR * trace][:components]
    columns = basis[:, keep]
    columns = columns * np.sign(columns[np.abs(columns).argmax(0), np.arange(len(keep))])
    root = np.sqrt(values[keep])
    error = np.abs(g[np.ix_(keep, keep)] / np.outer(root, root) - np.eye(len(keep))).max()
    return Whitening(dims, scale, state.n, tuple(state.sums), columns, values[keep], trace, float(error))


# ------------------------------------------------------------ whitened rows
def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over the dimensions of (n * x - sums) ** 2, exactly; None beyond the range of a long."""
    high = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    reach = n * high + max(map(abs, sums))
    if len(sums) * reach * reach <= _LONG.max:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [s if s <= _LONG.max else None for s in (int((row * row).sum()) for row in off)]


WHITENED = "{id} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: its whitened value, and the fit's figures.  Narrow."""
    schema = WHITENED.format(id=id_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    arrow = arrow_schema(schema)
    k = len(model.values)
    shift = np.array([s / model.n for s in model.sums])
    project = model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([unpack(raw) for raw in batch.column(1).to_pylist()])
            m = len(x)
            cols = [np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k) if not batch.column(0).null_count else [i for i in batch.column(0).to_pylist() for _ in range(k)],
                    np.tile(np.arange(1, k + 1), m), np.full(m * k, model.n), [s for s in deviations(x, model.n, model.sums) for _ in range(k)],
                    ((x - shift) @ project).ravel(), np.tile(model.values / model.trace, m), np.full(m * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return quantise(vectors, id_col, vec_col, model.scale).where(F.col("dims") == model.dims).select("id", "x").mapInArrow(run, schema)
