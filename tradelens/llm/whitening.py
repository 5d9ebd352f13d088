"""Whitening components of embeddings by shifted CholeskyQR (operator 13).

Entries are put on a grid, ``x = floor(scale * c)``, so that sums are exact
and copies are found by equality.  The fit list holds every distinct vector
once.  Its centred rows A are made orthogonal by repeated distributed passes:
a pass sends each block of rows through the triangular factors so far and
adds up the Gram matrix of what remains; the driver (which only sees matrices
of dimension x dimension) takes its Cholesky factor.  The first factor is
shifted, so that it exists however badly conditioned A is; the second and
third pass make up for the shift (further ones follow where a direction has
no variance at all).  The composed factor R has the singular values and right
singular vectors of A without ever squaring them, so SVD of R gives the
eigenvectors of the covariance to double precision.

On Spark: equal vectors meet by their bytes (copies of a hot vector collapse
before the shuffle); the fit list is written once and read by every pass; a
task adds its rows up and sends one matrix, by rows, to the tasks that total
them.  Nothing else is shuffled; rows are projected where they are read.

Defined results: a row whose vector is null, is empty or holds a null, NaN
or infinite entry is dropped; entries beyond the range of a long are held at
its ends; the dimension is the length most distinct vectors have (of equal
counts, the greater), rows of another length are dropped; repeated rows are
answered each, but fit once; directions without variance have no component,
so a table with one distinct vector or none gives no rows; equal eigenvalues
share a space, of which one basis is used for all rows; ``deviation`` beyond
38 digits is null; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, named

EPS = float(np.finfo(float).eps)
RANK_TOLERANCE = 1e-13  # of the largest singular value; rounding of A lies below it
MAX_PASSES = 6
LONG = np.iinfo(np.int64)


def grid(vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of an ``array<double>`` column by their length: row
    numbers and grid vectors (a row each)."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().to_numpy(zero_copy_only=False)  # a null entry is NaN
    start = np.cumsum(length) - length
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = (length > 0) & (bad[start + length] == bad[start])
    found = {}
    for dim in np.unique(length[usable]):
        rows = np.nonzero(usable & (length == dim))[0]
        with np.errstate(over="ignore"):
            x = np.floor(scale * entries[start[rows, None] + np.arange(dim)])
        inside = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        found[int(dim)] = rows, np.where(x >= 2.0**63, LONG.max, inside)
    return found


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes an entry that holds it."""
    lo, hi = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), dtype=bool)
    for width in (2, 4, 8):
        limit = 1 << 8 * width - 1
        own = left & (lo >= -limit) & (hi <= limit - 1)
        raw, size = x[own].astype(f"<i{width}").tobytes(), width * x.shape[1]
        for k, i in enumerate(np.nonzero(own)[0]):
            out[i] = raw[k * size : (k + 1) * size]
        left &= ~own
    return out


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Grid vectors of a batch of ``x`` (packed) as one matrix."""
    values = batch.column("x").to_pylist()
    size = np.array([len(v) for v in values], dtype=np.int64)
    out = np.empty((len(values), dim), dtype=np.int64)
    for width in (2, 4, 8):
        own = np.nonzero(size == width * dim)[0]
        out[own] = np.frombuffer(b"".join(values[i] for i in own), dtype=f"<i{width}").reshape(-1, dim)
    return out


def distinct_vectors(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """``dim, x`` (packed grid vector) of every distinct usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (_, x) in grid(b.column("v"), scale).items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, dtype=np.int32)), pa.array(packed(x), pa.binary())], ["dim", "x"])

    return vectors.select(named(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "dim int, x binary").distinct()


@dataclass
class Centre:
    """The mean S/n, as a whole part (exact on the grid) and the rest."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=object)
        self.rest = np.array([float(Fraction(s, self.n) - s // self.n) for s in self.sums])
        self.near = max((abs(int(w)) for w in self.whole), default=0) < 1 << 62

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision."""
        if self.near and (not x.size or max(int(x.max()), -int(x.min())) < 1 << 62):
            return (x - self.whole.astype(np.int64)).astype(np.float64) - self.rest
        return (x.astype(object) - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n*x - S)^2, exact."""
        reach = self.n * max((abs(int(v)) for v in (x.min(), x.max())), default=0) + max(map(abs, self.sums)) if x.size else 0
        kind = np.int64 if len(self.sums) * reach * reach <= LONG.max else object
        d = x.astype(kind) * kind(self.n) - np.array(self.sums, dtype=kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [int(v) for v in (d * d).sum(axis=1)]


def _centre(fit: DataFrame, dim: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, dtype=object)
        for b in batches:
            x = _matrix(b, dim)
            small = x.size and max(int(x.max()), -int(x.min())) < 1 << 40  # a batch has far fewer than 2^23 rows
            sums = sums + (x if small else x.astype(object)).sum(axis=0).astype(object)
            n += len(x)
        values = [n, *map(int, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "s"])

    totals = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # dim + 1 rows
    at = {r["i"]: int(r["s"]) for r in totals}
    return Centre(at[0], [at[i + 1] for i in range(dim)])


def through(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows after the triangular solves with each factor in turn: A R1^-1 R2^-1 ..."""
    q = np.ascontiguousarray(a.T)  # R' Q' = A': one dimension after the other, over all rows
    for r in factors:
        for j in range(len(r)):
            q[j] = (q[j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def _gram(fit: DataFrame, dim: int, rows_of) -> np.ndarray:
    """Gram matrix of ``rows_of(grid vectors)`` over the fit list."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            a = rows_of(_matrix(b, dim))
            total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "r"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column("i").to_pylist(), b.column("r").to_pylist()):
                total[i] = total.get(i, 0.0) + np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["i", "r"])

    schema = "i int, r binary"
    rows = fit.mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema).collect()  # one row per dimension
    return np.array([np.frombuffer(bytes(r["r"])) for r in sorted(rows, key=lambda r: r["i"])])


def next_factor(gram: np.ndarray, n: int, first: bool) -> tuple[np.ndarray, bool]:
    """Upper Cholesky factor of a Gram matrix; whether it was shifted."""
    dim = len(gram)
    norm = float(np.linalg.eigvalsh(gram)[-1])
    if not first:
        try:
            return np.linalg.cholesky(gram).T, False
        except np.linalg.LinAlgError:  # a direction without variance
            shift = 10 * dim * EPS * norm
    else:
        shift = 11 * (n * dim + dim * (dim + 1)) * (EPS / 2) * norm
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(dim)).T, True
        except np.linalg.LinAlgError:
            shift *= 10


@dataclass
class Whitening:
    """Fitted components: ``basis`` (a unit column each) by falling
    ``eigenvalues``, the ``trace`` of the covariance, the composed ``factor``
    R of the centred fit list (R'R = A'A) and ``identity_error``, the largest
    absolute entry of the whitened fit list's covariance minus the identity."""

    dim: int
    centre: Centre
    eigenvalues: np.ndarray
    basis: np.ndarray
    trace: float
    factor: np.ndarray
    passes: int
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.basis / np.sqrt(self.eigenvalues)


def fit_whitening(vectors: DataFrame, vec_col: str, components: int | None = None, scale: int = 256) -> Whitening | None:
    """Components of the distinct grid vectors (all of nonzero variance, or
    the first ``components``); None if there is none."""
    fit = cut(distinct_vectors(vectors, vec_col, scale), "whitening-fit")
    common = fit.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return None
    dim = common["dim"]
    fit = fit.filter(F.col("dim") == dim).select("x")
    centre = _centre(fit, dim)
    factors: list[np.ndarray] = []
    trace = 0.0
    while len(factors) < MAX_PASSES:
        done = list(factors)
        gram = _gram(fit, dim, lambda x: through(centre.centred(x), done))
        if not factors:
            trace = float(np.trace(gram)) / centre.n
            if trace == 0:
                return None
        r, shifted = next_factor(gram, centre.n, first=not factors)
        factors.append(r)
        if not shifted and np.abs(gram - np.eye(dim)).max() < 1e-12:
            break
    composed = np.eye(dim)
    for r in factors:
        composed = r @ composed
    _, sigma, vt = np.linalg.svd(composed)
    rank = int((sigma > RANK_TOLERANCE * sigma[0]).sum())
    k = rank if components is None else min(rank, components)
    basis = vt[:k].T
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])  # largest entry positive
    model = Whitening(dim, centre, sigma[:k] ** 2 / centre.n, basis, trace, composed, len(factors), 0.0)
    covariance = _gram(fit, dim, model.project) / centre.n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """One row per usable row and component: ``id, component, n, deviation,
    whitened, explained, identity_error``."""
    rows = vectors.select(named(id_col).alias("id"), named(vec_col).cast("array<double>").alias("v"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, n = len(model.eigenvalues), model.centre.n
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = grid(b.column("v"), scale).get(model.dim, (None, None))
            if at is None:
                continue
            deviation = pa.array([v if v < 10**38 else None for v in model.centre.deviation(x)], pa.decimal128(38, 0))
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    deviation.take(pa.array(each)),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
