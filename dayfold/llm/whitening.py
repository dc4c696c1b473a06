"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the eigenvalues and eigenvectors of the scatter of its vectors and updates them by centred
rank-one terms: a term turns the eigenvalues into the roots of a secular equation, after terms that do not
move an eigenvalue have been deflated. A block of vectors enters by the rows of its triangular factor, which
have the same scatter as the block, and by the shift of its mean; so the number of updates does not grow with
the block. Spectra of tasks are combined in a tree: the eigenpairs of one are rank-one terms for the other.
The result serves as basis of a Rayleigh-Ritz step over all vectors, which brings the eigenvectors to double
precision.

Vectors are whole numbers, floor(1024 c) + 100000 for an entry c, so counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import importable, released, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors that enter a spectrum at a time.
BLOCK = 16_384
#: Spectra that one task combines.
FAN_IN = 8
#: An entry whose scaled size reaches this counts as not finite.
LARGEST = 2.0 ** 31
#: Halvings of the interval of each root.
HALVINGS = 80
EPS = np.finfo(float).eps
SPECTRUM = "part long, n long, sums binary, eigenvalues binary, vectors binary"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Spectrum(NamedTuple):
    """Count, exact sums and eigendecomposition of the scatter about the mean of some vectors."""

    n: int
    sums: np.ndarray    # Python integers
    d: np.ndarray       # eigenvalues, rising
    q: np.ndarray       # eigenvectors, one in each column

    @property
    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(float)


def nothing(dims: int) -> Spectrum:
    return Spectrum(0, np.zeros(dims, object), np.zeros(dims), np.eye(dims))


def _deflate(d: np.ndarray, z: np.ndarray, q: np.ndarray, weight: float) -> np.ndarray:
    """Rotates (in place) what two nearly equal eigenvalues share into one of them; the places that still move."""
    moving = []
    tolerance = 8 * EPS * max(float(np.abs(d).max()), weight)
    for j in range(len(d)):
        if weight * abs(z[j]) <= tolerance:
            z[j] = 0
            continue
        if moving:
            i = moving[-1]
            size = np.hypot(z[i], z[j])
            c, s = z[j] / size, z[i] / size
            if abs((d[j] - d[i]) * c * s) <= tolerance:
                z[i], z[j] = 0, size
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                moving.pop()
        moving.append(j)
    return np.array(moving, np.int64)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Matrix of d[i] - root[j] for the roots of 1 + sum(z2 / (d - x)) = 0; d rises strictly, z2 is positive.

    Root j lies between d[j] and the next d. Each root is measured from the nearer of the two, so that the
    differences keep their relative precision.
    """
    width = np.append(np.diff(d), z2.sum())
    middle = d + width / 2
    with np.errstate(divide="ignore"):
        above = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(axis=0) < 0  # the root lies beyond the middle
    above[-1] = False
    origin = np.where(above, np.append(d[1:], d[-1]), d)
    gap = d[:, None] - origin[None, :]
    low = np.where(above, -width / 2, 0.0)
    high = np.where(above, 0.0, width / 2)
    high[-1] = width[-1]
    for _ in range(HALVINGS):
        x = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            negative = 1 + (z2[:, None] / (gap - x[None, :])).sum(axis=0) < 0
        low, high = np.where(negative, x, low), np.where(negative, high, x)
    return gap - ((low + high) / 2)[None, :]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of q diag(d) q' + weight v v', weight not negative; d rises and stays rising."""
    z = np.sqrt(weight) * (q.T @ v)
    size = float(z @ z)
    if size == 0:
        return d, q
    d, q, z = d.copy(), q.copy(), z / np.sqrt(size)
    moving = _deflate(d, z, q, size)
    if not len(moving):
        return d, q
    order = moving[np.argsort(d[moving], kind="stable")]
    at, power = d[order], size * z[order] ** 2
    distinct = np.append(True, np.diff(at) > 0)
    if not distinct.all():  # equal to the last bit and yet not deflated: nothing moves them apart but rounding
        at = at + np.cumsum(~distinct) * EPS * max(float(np.abs(at).max()), size)
    differences = secular_roots(at, power)
    others = at[:, None] - at[None, :]
    np.fill_diagonal(others, 1)
    ratio = differences / np.where(np.eye(len(at), dtype=bool), 1, others)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1)))  # the term whose roots are exactly those found: vectors stay orthogonal
    with np.errstate(divide="ignore", invalid="ignore"):
        turned = np.where(z[order] < 0, -exact, exact)[:, None] / differences
    turned = np.nan_to_num(turned, nan=0.0, posinf=1e300, neginf=-1e300)
    turned /= np.abs(turned).max(axis=0)
    turned /= np.linalg.norm(turned, axis=0)
    q[:, order] = q[:, order] @ turned
    d[order] = at - np.diag(differences)
    rising = np.argsort(d, kind="stable")
    return d[rising], q[:, rising]


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of both sets of vectors: b's eigenpairs and the shift of the means as rank-one terms for a."""
    if not a.n or not b.n:
        return a if a.n else b
    d, q = a.d, a.q
    for value, vector in zip(b.d[::-1], b.q.T[::-1]):
        if value > 0:
            d, q = rank_one(d, q, vector, float(value))
    d, q = rank_one(d, q, b.mean - a.mean, a.n * b.n / (a.n + b.n))
    return Spectrum(a.n + b.n, a.sums + b.sums, d, q)


def with_block(spectrum: Spectrum, x: np.ndarray) -> Spectrum:
    """The spectrum with a block of vectors (whole numbers, one in each row) added."""
    if not len(x):
        return spectrum
    sums = np.array(x.sum(axis=0).tolist(), object)
    mean = (sums / len(x)).astype(float)
    factor = np.linalg.qr(x - mean, mode="r")
    d, q = spectrum.d, spectrum.q
    for row in factor:
        d, q = rank_one(d, q, row, 1.0)
    if spectrum.n:
        d, q = rank_one(d, q, mean - spectrum.mean, spectrum.n * len(x) / (spectrum.n + len(x)))
    return Spectrum(spectrum.n + len(x), spectrum.sums + sums, d, q)


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    sums = np.array(s.sums.tolist(), np.int64)
    values = [[part], [s.n], [sums.tobytes()], [s.d.tobytes()], [np.ascontiguousarray(s.q).tobytes()]]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["part", "n", "sums", "eigenvalues", "vectors"])


def _spectrum(row: dict) -> Spectrum:
    d = np.frombuffer(bytes(row["eigenvalues"]))
    sums = np.frombuffer(bytes(row["sums"]), np.int64)
    return Spectrum(row["n"], np.array(sums.tolist(), object), d, np.frombuffer(bytes(row["vectors"])).reshape(len(d), len(d)))


def whole_vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's vectors as whole numbers."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(whole_vectors(batch, dims))
        n += batch.num_rows
        if n >= BLOCK:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, embedding of doubles), dims): the rows whose vector is there, whole and finite."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(SCALE * c) < LARGEST), F.lit(False)))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    most = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return (rows, 0) if most is None else (rows.where(F.size("embedding") == most.dims), most.dims)


def spectrum_of(rows: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all vectors: one of each task, then combined `FAN_IN` at a time until one is left."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = nothing(dims)
        for x in _blocks(batches, dims):
            s = with_block(s, x)
        if s.n:
            yield _row(0, s)

    def join(table: pa.Table) -> pa.Table:
        s = nothing(dims)
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            s = combined(s, _spectrum(row))
        return pa.Table.from_batches([_row(table.column("part")[0].as_py() // FAN_IN, s)])

    parts = rows.select("embedding").mapInArrow(released(start), SPECTRUM).withColumn("part", F.spark_partition_id().cast("long"))
    parts = written(parts, "spectra")
    while parts.count() > 1:
        parts = written(parts.groupBy(F.expr(f"part div {FAN_IN}").alias("of")).applyInArrow(join, SPECTRUM), "spectra")
    found = parts.first()  # dims x dims numbers
    return nothing(dims) if found is None else _spectrum(found.asDict())


def _products(rows: DataFrame, dims: int, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the vectors, centred and projected on the basis, over all rows.

    Tasks send their triangular sums as rows that are added up by place, so the driver gets one for each place.
    """
    k = basis.shape[1]
    at = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, dims):
            y = centred(x, n, sums) @ basis
            first += y.sum(axis=0)
            second += y.T @ y
        values = np.concatenate((first, second[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "value"])

    added = rows.select("embedding").mapInArrow(released(run), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = np.zeros(k + len(at[0]))
    for r in added.collect():
        values[r.place] = r.value
    products = np.zeros((k, k))
    products[at] = values[k:]
    return values[:k], products + np.triu(products, 1).T


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exact."""
    exact = np.int64 if n < 2 ** 30 else object
    return n * x.astype(exact) - np.array(sums.tolist(), exact)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """sum((n x - sums) ** 2) of each row, exact."""
    d = _scaled(x, n, sums)
    high = int(abs(d).max(initial=0))
    if d.shape[1] * high * high < 2 ** 63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


class Whitening(NamedTuple):
    """What whitens: count, exact sums, the projection (dims x components) and what each component explains."""

    n: int
    sums: np.ndarray
    projection: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows; None if there is no row or all vectors are equal.

    Components whose eigenvalue is zero up to rounding cannot be whitened and are left out.
    """
    s = spectrum_of(rows, dims) if dims else nothing(0)
    if not s.n:
        return None
    basis, _ = np.linalg.qr(s.q)
    _, products = _products(rows, dims, s.n, s.sums, basis)
    e, turned = np.linalg.eigh(products / s.n)
    e, vectors = e[::-1], basis @ turned[:, ::-1]
    few = int((e > dims * EPS * max(e[0], 0) * 8).sum()) if e[0] > 0 else 0
    few = min(few, components)
    return Whitening(s.n, s.sums, vectors[:, :few] / np.sqrt(e[:few]), e[:few] / np.trace(products / s.n)) if few else None


def identity_error(rows: DataFrame, dims: int, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all rows."""
    first, second = _products(rows, dims, w.n, w.sums, w.projection)
    mean = first / w.n
    return float(np.abs(second / w.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component; columns see `WHITENED`.

    A null vector, an empty one, and one with a null, infinite, NaN or immense (2 ** 31 and more after scaling)
    entry is dropped, as is one whose length is not that of most vectors (of equals the greater length). All
    others are fitted and returned, repeated rows and null ids too. Equal eigenvalues keep any of their
    vectors, the same for all rows. There are as many components as the covariance has rank, `components` at
    most: none if all vectors are equal. A deviation beyond 64 bits is null. Other columns are ignored,
    whatever their names; an empty table gives no row.
    """
    spark = embeddings.sparkSession
    importable(spark)
    rows, dims = usable(embeddings, id_col, vector_col)
    w = fit(rows, dims, components)
    if w is None:
        return spark.createDataFrame([], WHITENED)
    error, few = identity_error(rows, dims, w), len(w.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_vectors(batch, dims)
            m = len(x)
            repeated = np.repeat(np.arange(m), few)
            deviation = pa.array([v if v < 2 ** 63 else None for v in deviations(x, w.n, w.sums)], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(repeated)),
                pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), m)),
                pa.array(np.full(m * few, w.n)),
                deviation.take(pa.array(repeated)),
                pa.array((centred(x, w.n, w.sums) @ w.projection).ravel()),
                pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * few, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(released(run), WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of `embeddings`, whitened on the first eight components; see `whitened`."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
