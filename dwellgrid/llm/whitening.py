"""Embedding whitening: blockwise QR of the centred rows, then the bidiagonal solver on what is left of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm.bidiagonal import leading_directions
from dwellgrid.llm.common import ship_package

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = 1 << 48  # of a whole number from an entry: sums of a batch stay within 64 bits
FAN_IN = 32


@dataclass(frozen=True)
class Fit:
    """``n`` rows with exact sums per dimension; ``vectors`` are unit eigenvectors of their covariance as columns,
    ``values`` the eigenvalues that go with them, descending, and ``trace`` the sum of all eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        """Which components vary at all, at the precision of the numbers."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values, default=0.0)


def whole_rows(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number rows ``floor(1024 * c) + 100000`` of the usable vectors of a batch (``id, vec``).

    A null vector, or one with a null, infinite or not-a-number entry, is left out, and so is one without entries.
    """
    vecs = batch.column(1)
    sizes = np.asarray(vecs.value_lengths().fill_null(0))
    flat = vecs.flatten().cast(pa.float64())
    finite = np.isfinite(np.asarray(flat.fill_null(np.nan), np.float64))
    before = np.concatenate([[0], np.cumsum(~finite)])
    ends = np.cumsum(sizes)
    good = np.flatnonzero((sizes > 0) & (before[ends] == before[ends - sizes]))
    widths = np.unique(sizes[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths.tolist()}")
    width = int(widths[0]) if len(widths) else 0
    places = (ends - sizes)[good][:, None] + np.arange(width)
    found = np.floor(SCALE * np.asarray(flat.fill_null(0.0), np.float64)[places])
    if found.size and np.abs(found).max() >= LARGEST:
        raise ValueError("an entry is too large to be made a whole number")
    return batch.column(0).take(pa.array(good)), found.astype(np.int64) + OFFSET


def _only(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of usable rows and exact sums per dimension; a row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for batch in batches:
            _, x = whole_rows(batch)
            if len(x):
                n += len(x)
                some = [int(s) for s in x.sum(axis=0)]
                if total and len(total) != len(some):
                    raise ValueError(f"vectors of different lengths: {len(total)} and {len(some)}")
                total = [a + b for a, b in zip(total, some)] if total else some
        if n:
            places = np.arange(len(total), dtype=np.int32)
            counts = np.full(len(total), n, np.int64)
            arrays = [pa.array(places), pa.array(counts), pa.array([str(t) for t in total])]
            yield pa.RecordBatch.from_arrays(arrays, ["dim", "n", "total"])

    parts = rows.mapInArrow(add, "dim int, n long, total string")
    summed = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = sorted((r["dim"], r["n"], int(r["total"])) for r in summed.collect())
    if len({n for _, n, _ in found}) > 1:
        raise ValueError("vectors of different lengths")
    return (found[0][1] if found else 0), tuple(t for _, _, t in found)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S / n``: the whole part of the mean is taken off exactly."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - (s // n) * n) / n for s in sums])
    return (x - base) - rest


def _triangle(parts: list[np.ndarray], width: int) -> np.ndarray:
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def _reduced(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The triangular factor of all centred rows.

    Every partition folds its batches into one triangle; triangles are folded in a tree of at most 32 a task after the
    first level, so neither a task nor the driver holds more than one triangle and one block of rows.
    """
    width = len(sums)
    schema = "part long, r binary"

    def out(part: int, r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()])], ["part", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            _, x = whole_rows(batch)
            if len(x):
                r = _triangle([_centred(x, n, sums)] if r is None else [r, _centred(x, n, sums)], width)
        yield from out(TaskContext.get().partitionId(), r)

    def reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for blob in batch.column(1):
                other = np.frombuffer(blob.as_py()).reshape(width, width)
                r = other if r is None else _triangle([r, other], width)
        yield from out(TaskContext.get().partitionId(), r)

    triangles = rows.mapInArrow(reduce_rows, schema)
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        placed = triangles.repartitionById(groups, F.pmod("part", F.lit(groups)).cast("int"))
        triangles = placed.mapInArrow(reduce_triangles, schema)
        if groups == 1:
            break
        groups = math.ceil(groups / FAN_IN)
    return np.frombuffer(triangles.first()["r"]).reshape(width, width)


def fitted(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> Fit | None:
    """The whitening directions of all usable vectors; None where there are none.

    Two passes over the vectors: exact sums, then the triangular factor of the centred rows, whose singular values and
    leading right singular vectors are those of the rows.  The driver receives sums and one triangle, both of a size that
    the dimension alone decides.
    """
    ship_package(vectors.sparkSession)
    rows = _only(vectors, id_col, vec_col)
    n, sums = _sums(rows)
    if not n:
        return None
    squares, directions = leading_directions(_reduced(rows, n, sums), min(components, len(sums)))
    return Fit(n, sums, squares[: directions.shape[1]] / n, directions, float(squares.sum()) / n)


def _projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates; not-a-number for components that do not vary."""
    scale = np.where(fit.usable(), np.sqrt(np.where(fit.usable(), fit.values, 1.0)), np.nan)
    return _centred(x, fit.n, fit.sums) @ fit.vectors / scale


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sum over the dimensions of ``(n * x - S) ** 2`` per row, in 64 bits where they hold it."""
    base = np.array([s // n for s in sums], np.int64)
    left = [s - (s // n) * n for s in sums]
    most = int(np.abs(x - base).max()) + 1 if x.size else 0
    if (most * n) ** 2 * max(1, x.shape[1]) < 1 << 62:
        return np.square(n * (x - base) - np.array(left, np.int64)).sum(axis=1).tolist()
    return [sum((n * int(v) - r) ** 2 for v, r in zip(row, left)) for row in (x - base).tolist()]


def identity_error(vectors: DataFrame, fit: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; null if no component varies.

    Batches are centred before multiplying and their moments added up: per partition one row of fixed size.
    """
    use = np.flatnonzero(fit.usable())
    k = len(use)
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 2 * k * k)
        for batch in batches:
            _, x = whole_rows(batch)
            if len(x):
                w = _projected(x, fit)[:, use]
                mean = w.mean(axis=0)
                inner = (w - mean).T @ (w - mean)
                total += np.concatenate([len(w) * mean, inner.ravel(), len(w) * np.outer(mean, mean).ravel()])
        arrays = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(arrays, ["place", "value"])

    parts = _only(vectors, id_col, vec_col).mapInArrow(moments, "place int, value double")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.array([v for _, v in sorted((r["place"], r["value"]) for r in found)])
    mean = total[:k] / fit.n
    second = (total[k : k + k * k] + total[k + k * k :]).reshape(k, k) / fit.n - np.outer(mean, mean)
    return float(np.abs(second - np.eye(k)).max())


def whitened(vectors: DataFrame, fit: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, whitened, deviation`` per usable vector, in place without shuffle: the coordinates along the fit's
    components (null where one does not vary) and the exact squared deviation from the mean, times ``n`` squared."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_rows(batch)
            if len(x):
                w = _projected(x, fit)
                flat = pa.array(w.ravel(), from_pandas=True)
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                deviation = pa.array([str(d) for d in deviations(x, fit.n, fit.sums)])
                arrays = [ids, pa.ListArray.from_arrays(ends, flat), deviation]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "whitened", "deviation"])

    ship_package(vectors.sparkSession)
    found = _only(vectors, id_col, vec_col).mapInArrow(project, "vec_id long, whitened array<double>, deviation string")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _nothing(spark: SparkSession) -> DataFrame:
    schema = (
        "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    return spark.createDataFrame([], schema)


def component_rows(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Defined cases: vectors that are null, empty, or hold null or non-finite entries have no rows and are not fitted.
    Null and repeated ids pass through, row for row; repeated vectors count as often as they come.  Vectors of different
    lengths, and entries beyond 2**38, end the job with an error.  A component along which nothing varies has a null
    ``whitened``; where nothing varies at all ``explained`` and ``identity_error`` are null as well.  Equal eigenvalues
    get some orthonormal basis of their space.  Without usable vectors there are no rows.
    """
    fit = fitted(vectors, components, id_col, vec_col)
    if fit is None:
        return _nothing(vectors.sparkSession)
    error = identity_error(vectors, fit, id_col, vec_col)
    shares = [float(v / fit.trace) if fit.trace > 0 else None for v in fit.values]
    rows = whitened(vectors, fit, id_col, vec_col)
    placed = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return placed.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in shares]), "place").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
