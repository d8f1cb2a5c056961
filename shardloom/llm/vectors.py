"""Vectors as matrices of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vector as array<double>) of the rows of a dimension that take part, and that dimension.

    Without ``dim`` it is the most common one; rows without id take no part.
    """
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    if dim is None:
        dim = next(iter(dimensions(vectors, id_col, vector_col)), 0)
    return rows.where(F.size("vector") == dim), dim


def dimensions(vectors: DataFrame, id_col: str, vector_col: str) -> list[int]:
    """The dimensions of the rows that take part, the most common first; tables have few."""
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    counts = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d")
    return [r["d"] for r in counts.collect()]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def bytes_of(column: pa.Array, dim: int, kind: type) -> pa.Array:
    """Each vector as the bytes of its components; equal vectors (zeros of either sign too) have equal bytes."""
    rows = np.ascontiguousarray(matrix(column, dim) + 0.0, dtype=kind)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def points_of(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """Vectors of :func:`bytes_of` in doubles, each scaled by a power of two (exactly) so that squares stay finite."""
    points = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    _, exponent = np.frexp(np.abs(points).max(1, initial=0.0))
    return np.ldexp(points, -exponent[:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed dimension by dimension: the same double for the same two vectors always."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """(rows of a, rows of b): whether the cosine reaches ``threshold``; what single precision leaves open is told by :func:`dots`."""
    single = [(x / np.sqrt(dots(x, x))[:, None]).astype(np.float32) for x in (a, b)]
    rough, slack = single[0] @ single[1].T, 1e-6 + 2.5e-7 * a.shape[1]
    found = rough >= threshold + slack
    i, j = np.nonzero((rough >= threshold - slack) & ~found)
    for at in range(0, len(i), 1 << 16):
        x, y = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        found[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = dots(x, y) / np.sqrt(dots(x, x) * dots(y, y)) >= threshold
    return found
