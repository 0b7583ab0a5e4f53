"""Embedding whitening (operator 11).

Vectors are put on a grid of whole numbers, so that means are exact. The covariance is one aggregation: a sum of centred products for
each pair of dimensions on or above the diagonal, as Spark expressions made from the number of dimensions. Its row
of numbers (at most half the square of the dimensions) is all that the driver gets; LAPACK decomposes the matrix there, and
the components go to the tasks that project the rows.

The fit list holds each different vector once, so that copies have no weight; it is written to the shared folder as Parquet
and read by three passes: sums, products, and the products of the whitened vectors, whose distance from the identity is measured.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors that are not as long as
most (of lengths equally common the smallest counts); entries beyond 2^40 in absolute value count as 2^40. Repeated rows and
rows without an id have their results each. Components whose eigenvalue is zero to double precision can't be scaled and
aren't returned (so one vector alone, or equal ones, give no rows); an empty table gives none either. `deviation` is null where
it exceeds a long; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import ensure_checkpoint_dir

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
FARTHEST = float(1 << 40)
#: Expressions of one aggregation: all pairs of up to 90 dimensions; more dimensions take more aggregations.
EXPRESSIONS = 4096
_LOW = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What the tasks need: n, sums, components as columns, each with its share of the variance, and the measured error."""

    n: int
    sums: tuple[int, ...]
    scaled: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def gridded(vectors: DataFrame, vector: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """The usable rows with x, the vector on the grid."""
    c = F.col(vector).cast("array<double>")
    usable = vectors.filter(F.size(c) == dimensions if dimensions else F.size(c) > 0).filter(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    near = lambda e: F.greatest(F.least(e, F.lit(FARTHEST)), F.lit(-FARTHEST))
    return usable.withColumn("x", F.transform(c, lambda e: (F.floor(near(e) * SCALE) + OFFSET).cast("long")))


def commonest_size(vectors: DataFrame, vector: str = "embedding") -> int | None:
    sizes = gridded(vectors, vector).groupBy(F.size("x").alias("size")).count()
    first = sizes.orderBy(F.desc("count"), "size").first()
    return first["size"] if first else None


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, whose encodings suit small whole numbers better than a checkpoint's rows."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/fit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sums(fit: DataFrame, dimensions: int, x: str = "x") -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension, gathered as high and low parts that can't overflow."""
    e = [F.col(x)[i] for i in range(dimensions)]
    row = fit.agg(F.count("*"), *(F.sum(F.shiftright(c, 20)) for c in e), *(F.sum(c.bitwiseAND(_LOW - 1)) for c in e)).first()
    n, told = row[0], [v or 0 for v in row[1:]]
    return n, [high * _LOW + low for high, low in zip(told[:dimensions], told[dimensions:], strict=True)]


def upper_triangle(columns: list[str]) -> list[Column]:
    """A sum of products for each pair of columns on or above the diagonal, row by row."""
    return [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]


def covariance(centred: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """The covariance (divisor n) of columns whose means are taken off already."""
    wanted = upper_triangle(columns)
    told: list[float] = []
    for k in range(0, len(wanted), EXPRESSIONS):
        told += [v or 0.0 for v in centred.agg(*wanted[k : k + EXPRESSIONS]).first()]
    out = np.zeros((len(columns), len(columns)))
    out[np.triu_indices(len(columns))] = np.asarray(told) / n
    return out + np.triu(out, 1).T


def centred(fit: DataFrame, means: list[float], x: str = "x") -> tuple[DataFrame, list[str]]:
    names = [f"c{i}" for i in range(len(means))]
    return fit.select(*((F.col(x)[i].cast("double") - F.lit(m)).alias(name) for i, (m, name) in enumerate(zip(means, names, strict=True)))), names


def decompose(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors as columns, without those that are zero to double precision."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(values[0], 0.0) * len(v) * np.finfo(float).eps
    k = min(k, int((values > floor).sum()))
    return values[:k], vectors[:, :k]


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors; None where no component has any variance."""
    dimensions = commonest_size(vectors, vector)
    if not dimensions:
        return None
    fit = stored(gridded(vectors, vector, dimensions).select("x").distinct())
    n, s = sums(fit, dimensions)
    means = [v / n for v in s]
    v = covariance(*centred(fit, means), n)
    values, directions = decompose(v, components)
    if not len(values):
        return None
    found = Whitening(n, tuple(s), directions / np.sqrt(values), values / np.trace(v))
    names = [f"w{k}" for k in range(len(values))]
    whitened = project(fit.select("x"), found).select(*(F.col("w")[k].alias(name) for k, name in enumerate(names)))
    error = np.abs(covariance(whitened, names, n) - np.eye(len(names))).max()
    return Whitening(n, found.sums, found.scaled, found.explained, float(error))


def matrix(x: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of whole numbers."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def whiten(x: np.ndarray, w: Whitening) -> np.ndarray:
    return (x - np.asarray([s / w.n for s in w.sums])) @ w.scaled


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """sum((n*x - S)^2) of each row, exact; None beyond a long."""
    reach = max(int(np.abs(x).max()), *(abs(s) // w.n + 1 for s in w.sums))
    if (2 * w.n * reach) < 1 << 62:
        d = x * w.n - np.asarray(w.sums, dtype=np.int64)
        if int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
    else:
        d = x.astype(object) * w.n - np.asarray(w.sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def project(rows: DataFrame, w: Whitening) -> DataFrame:
    """x replaced by w, its coordinates on the scaled components."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = whiten(matrix(batch.column(0)), w)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.list_(pa.float64()))], names=["w"])

    return rows.mapInArrow(run, "w array<double>")


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(vectors: DataFrame, w: Whitening | None, vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component."""
    if w is None:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    rows = gridded(vectors, vector, len(w.sums)).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    k = len(w.explained)
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1))
            by_row = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(by_row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n, dtype=np.int64)),
                pa.array(deviations(x, w), pa.int64()).take(pa.array(by_row)),
                pa.array(whiten(x, w).ravel()),
                pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * k, w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, _SCHEMA)
