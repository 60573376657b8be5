"""Whitening of vectors by an incremental eigendecomposition.

Partitions update a spectrum by centred rank-one updates, each of which solves a secular equation after
deflation; spectra are combined by further rank-one updates, and a Rayleigh-Ritz step over all rows refines the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, settled

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that are condensed to a triangle of at most as many rows as dimensions before the updates.
BLOCK_ROWS = 8192
#: Spectra that one task combines.
FAN_IN = 8
#: Bisections of a secular equation; each root ends at the spacing of doubles within its interval.
BISECTIONS = 80
#: Eigenvalues below this share of the trace count as zero and have no component.
LEAST_SHARE = 1e-13

_EPS = float(np.finfo(np.float64).eps)


def _deflated(values: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``vectors`` turned within equal eigenvalues so that one of each carries their weight; which places are left."""
    tolerance = 8 * _EPS * max(float(np.abs(values).max(initial=0)), float(weights @ weights))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(values) > tolerance]))
    ends = np.append(starts[1:], len(values))
    vectors, weights = vectors.copy(), weights.copy()
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        length = float(np.linalg.norm(weights[a:b]))
        if length:
            turn, r = np.linalg.qr(weights[a:b, None], mode="complete")
            vectors[:, a:b] = vectors[:, a:b] @ turn
            weights[a:b] = 0
            weights[a] = r[0, 0]
    return vectors, weights, np.flatnonzero(np.abs(weights) * np.linalg.norm(weights) > tolerance)


def secular_roots(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, offset) of the roots of 1 + sum(weights^2 / (values - x)) = 0: each is values[base] + offset, measured
    from the nearer pole. ``values`` rise strictly."""
    square = weights ** 2
    k = len(values)
    width = np.append(np.diff(values), square.sum())
    middle = values + width / 2
    at_middle = 1 + (square / (values[None, :] - middle[:, None])).sum(axis=1)
    base = np.where((at_middle >= 0) | (np.arange(k) == k - 1), np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    poles = values[None, :] - values[base][:, None]
    low = np.where(base == np.arange(k), 0.0, -width / 2)
    high = np.where(base == np.arange(k), np.where(np.arange(k) == k - 1, width, width / 2), 0.0)
    for _ in range(BISECTIONS):
        offset = (low + high) / 2
        with np.errstate(divide="ignore"):
            above = 1 + (square / (poles - offset[:, None])).sum(axis=1) > 0
        low, high = np.where(above, low, offset), np.where(above, offset, high)
    return base, (low + high) / 2


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors * diag(values) * vectors' + x * x'."""
    vectors, weights, left = _deflated(values, vectors, vectors.T @ x)
    if not len(left):
        return values, vectors
    own, weight = values[left], weights[left]
    base, offset = secular_roots(own, weight)
    # differences pole - root, from the nearer pole, so that none is a difference of close numbers
    gaps = (own[:, None] - own[base][None, :]) - offset[None, :]
    gaps[gaps == 0] = np.finfo(np.float64).tiny
    # the weights for which the roots found are exact, which keeps the vectors orthogonal (Gu and Eisenstat 1994)
    k = len(own)
    ratio = -gaps.copy()
    apart = own[None, :] - own[:, None]
    np.fill_diagonal(apart, 1.0)
    product = np.abs(ratio) / np.where(np.eye(k, dtype=bool), 1.0, np.abs(apart))
    exact = np.sqrt(np.exp(np.log(product).sum(axis=1)))
    turn = (np.sign(weight) * exact)[:, None] / gaps
    turn /= np.linalg.norm(turn, axis=0)
    values = values.copy()
    values[left] = own[base] + offset
    vectors[:, left] = vectors[:, left] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def empty_spectrum(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(width), np.eye(width)


def updated(spectrum: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``spectrum`` after a rank-one update by each row; more rows than columns are condensed before."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for row in rows:
        spectrum = rank_one(*spectrum, row)
    return spectrum


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; of Python's whole numbers where a long is too short."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(differences: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where a long is too short."""
    most = int(np.abs(differences).max(initial=0)) ** 2 * max(differences.shape[1], 1)
    if most < 1 << 63:
        return (differences.astype(np.int64) ** 2).sum(axis=1).tolist()
    totals = (differences.astype(object) ** 2).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in totals]


def whole_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x (whole numbers) of the vectors that take part, and their width."""
    vector = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    usable = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > float(1 << 55)))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.coalesce(usable, F.lit(False)) & (F.size("vector") > 0))
    widths = known.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()
    if not widths:
        return known, 0
    width = max(widths, key=lambda w: (w.n, w.width)).width
    whole = F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return known.where(F.size("vector") == width).select("vec_id", whole.alias("x")), width


def _matrix(rows: pa.RecordBatch, width: int) -> np.ndarray:
    return rows.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _blocks(batches, width: int):
    held, n = [], 0
    for rows in batches:
        held.append(_matrix(rows, width))
        n += len(held[-1])
        if n >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def column_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    kinds = {"place": pa.int32(), "total": pa.decimal128(38, 0), "n": pa.int64()}

    def run(batches):
        for x in _blocks(batches, width):
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            totals = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            yield batch(kinds, place=range(width), total=[int(t) for t in totals], n=[len(x)] * width)

    found = vectors.select("x").mapInArrow(run, "place int, total decimal(38,0), n long")
    totals = {r.place: (r.n, int(r.total)) for r in found.groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    return totals[0][0], [totals[i][1] for i in range(width)]


def product_sums(vectors: DataFrame, width: int, n_out: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of p and of p p', where p = project(x) has ``n_out`` entries; only these reach the driver."""
    kinds = {"place": pa.int32(), "total": pa.float64()}
    size = n_out * (n_out + 1)

    def run(batches):
        total = np.zeros((n_out + 1, n_out))
        for x in _blocks(batches, width):
            p = project(x)
            total[0] += p.sum(axis=0)
            total[1:] += p.T @ p
        yield batch(kinds, place=range(size), total=total.reshape(-1))

    found = vectors.select("x").mapInArrow(run, "place int, total double")
    total = np.zeros(size)
    for r in found.groupBy("place").agg(F.sum("total").alias("total")).collect():
        total[r.place] = r.total
    return total[:n_out], total[n_out:].reshape(n_out, n_out)


_SPECTRUM = {"number": pa.int64(), "eigenvalues": pa.binary(), "eigenvectors": pa.binary()}
_SPECTRUM_SCHEMA = "number long, eigenvalues binary, eigenvectors binary"


def partition_spectra(vectors: DataFrame, width: int, n: int, sums: list[int]) -> DataFrame:
    """The spectrum of each partition's rows, about the mean of all rows."""

    def run(batches):
        spectrum, rows = empty_spectrum(width), 0
        for x in _blocks(batches, width):
            rows += len(x)
            spectrum = updated(spectrum, (centred(x, n, sums) / n).astype(np.float64) / np.sqrt(n))
        if rows:
            yield batch(_SPECTRUM, number=[TaskContext.get().partitionId()], eigenvalues=[spectrum[0].tobytes()],
                        eigenvectors=[spectrum[1].tobytes()])

    return vectors.select("x").mapInArrow(run, _SPECTRUM_SCHEMA)


def _read(values: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(values).copy(), np.frombuffer(vectors).reshape(width, width).copy()


def combined(spectra: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One spectrum of all ``spectra``, combined in tasks of ``FAN_IN`` at a time."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("number").to_pylist()
        spectrum = _read(rows[0]["eigenvalues"], rows[0]["eigenvectors"], width)
        for row in rows[1:]:
            values, vectors = _read(row["eigenvalues"], row["eigenvectors"], width)
            for value, vector in zip(values, vectors.T):
                if value > 0:
                    spectrum = rank_one(*spectrum, np.sqrt(value) * vector)
        return pa.Table.from_batches([batch(_SPECTRUM, number=[rows[0]["number"] // FAN_IN], eigenvalues=[spectrum[0].tobytes()],
                                            eigenvectors=[spectrum[1].tobytes()])])

    most = spectra.agg(F.max("number")).first()[0]
    while most > 0:
        spectra = settled(spectra.groupBy(F.floor(F.col("number") / FAN_IN)).applyInArrow(run, _SPECTRUM_SCHEMA), "spectra")
        most //= FAN_IN
    row = spectra.first()
    return _read(bytes(row.eigenvalues), bytes(row.eigenvectors), width)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector of ``rows`` (vec_id, embedding; other columns are ignored).

    Vectors that are null, empty or hold null or non-finite entries are left out, as are those of another than the most
    frequent width or with entries beyond 2^55. Each entry c becomes floor(64 c) + 1000000. Returns for each other row,
    repeated ones and those without an id included, and each component up to ``components``: vec_id, component (from 1 by
    falling eigenvalue), n, deviation (exact; null where a long is too short), whitened, explained, identity_error. Components
    whose eigenvalue is zero but for rounding have no whitened value and are left out; without any, or without rows, nothing
    is returned. To the driver come sums of a fixed size: d and d * d numbers.
    """
    spark = rows.sparkSession
    kinds = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(),
             "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, width = whole_vectors(rows)
    if not width:
        return spark.createDataFrame([], schema)
    vectors = settled(vectors, "whole-vectors")
    n, sums = column_sums(vectors, width)
    spectra = settled(partition_spectra(vectors, width, n, sums), "spectra")
    _, basis = combined(spectra, width)
    basis = np.linalg.qr(basis)[0]

    def onto(axes: np.ndarray):
        return lambda x: ((centred(x, n, sums) / n).astype(np.float64)) @ axes

    # Rayleigh-Ritz: the covariance within the basis, over all rows
    _, products = product_sums(vectors, width, width, onto(basis))
    values, turn = np.linalg.eigh((products + products.T) / (2 * n))
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], basis @ turn[:, order]
    trace = float(values.sum())
    kept = int(min(components, (values > trace * LEAST_SHARE).sum()))
    if not kept or trace <= 0:
        return spark.createDataFrame([], schema)
    scaled = axes[:, :kept] / np.sqrt(values[:kept])
    means, squares = product_sums(vectors, width, kept, onto(scaled))
    error = float(np.abs(squares / n - np.outer(means, means) / n ** 2 - np.eye(kept)).max())
    explained = values[:kept] / trace

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            x = _matrix(part, width)
            differences = centred(x, n, sums)
            coordinates = (differences / n).astype(np.float64) @ scaled
            m = len(x)
            yield batch(kinds, vec_id=part.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                        component=np.tile(np.arange(1, kept + 1), m), n=np.full(m * kept, n),
                        deviation=[d for d in deviations(differences) for _ in range(kept)], whitened=coordinates.reshape(-1),
                        explained=np.tile(explained, m), identity_error=np.full(m * kept, error))

    return vectors.mapInArrow(run, schema)
