"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised apart, so k centroids a half make k * k cells.  A query ranks the
centroids of each half by inner product and walks pairs of ranks with a heap, best sum first, until the
cells it has met hold enough entries.  These entries are reranked by exact inner products in doubles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .chunking import arrow_schema
from .vectors import dimensions, matrix, usable


class Codebook(NamedTuple):
    """Centroids of both halves and the number of entries of each cell (k * k numbers)."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @property
    def k(self) -> int:
        return len(self.first)


def centroids(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centers)
        sums, sizes = np.zeros_like(centers), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


def cells_of(points: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    half = first.shape[1]
    return nearest(points[:, :half], first) * len(first) + nearest(points[:, half:], second)


def visited_cells(query: np.ndarray, book: Codebook, enough: int) -> np.ndarray:
    """Cells in order of summed inner product until they hold ``enough`` entries (multi-sequence walk)."""
    half, k = book.first.shape[1], book.k
    near = [query[:half] @ book.first.T, query[half:] @ book.second.T]
    order = [np.argsort(-s, kind="stable") for s in near]
    a, b = (s[o].tolist() for s, o in zip(near, order))
    names = [o.tolist() for o in order]
    heap, front, found, total = [(-(a[0] + b[0]), 0, 0)], [0] * k, [], 0
    counts = book.counts
    # a row of pairs opens when the row above has moved past its first pair
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = names[0][i] * k + names[1][j]
        found.append(cell)
        total += int(counts[cell])
        if j + 1 < k:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < k:
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return np.array(found, np.int64)


def search(
    vectors: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 64, sample_rows: int = 20_000, visit_share: float = 0.6, block_rows: int = 4096, query_rows: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` entries of largest inner product that were found.

    ``is_query`` is a condition on ``vec_id``.  The codebook is fitted on at most ``sample_rows`` rows (the
    first by a hash of their id); every row is indexed.  ``visit_share`` of the entries are reranked per
    query, which sets the recall at every size.  Ties go to the smaller id; rows of the query's own id are no
    candidates; repeated rows of another id are.  Vectors that are null, zero, or hold null or non-finite
    components take no part; candidates are those of the query's dimension.  No usable vector: no rows.
    """
    dims = dimensions(vectors, id_col, vector_col) or [0]
    settings = (is_query, top, id_col, vector_col, k, sample_rows, visit_share, block_rows, query_rows)
    return reduce(DataFrame.unionByName, [_search(vectors, dim, *settings) for dim in dims])


def _search(
    vectors: DataFrame, dim: int, is_query, top: int, id_col: str, vector_col: str, k: int, sample_rows: int, visit_share: float,
    block_rows: int, query_rows: int,
) -> DataFrame:
    """:func:`search` among the vectors of one dimension."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col, dim)
    spec = "query_id long, vec_id long, score double"
    final = "query_id long, rank int, vec_id long, score double"
    if dim == 0:
        return spark.createDataFrame([], final)
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    points = matrix(sampled.column(0), dim)
    half, k = dim // 2, max(1, min(k, len(points) // 32))
    book = Codebook(centroids(points[:, :half], k), centroids(points[:, half:], k), np.zeros(k * k, np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells_of(matrix(batch.column(1), dim), book.first, book.second)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "vector", "cell"])

    indexed = rows.mapInArrow(assign, "vec_id long, vector array<double>, cell long")
    for cell, n in indexed.groupBy("cell").count().collect():  # k * k lines at most
        book.counts[cell] = n
    n_rows = int(book.counts.sum())
    enough = max(top + 1, math.ceil(visit_share * n_rows))
    # neighbouring cells lie together in blocks; a cell larger than a block is split by a hash of the id
    block_of = np.cumsum(book.counts) // block_rows
    splits = np.maximum(1, -(-book.counts // block_rows))
    lookup = spark.createDataFrame(
        [(int(c), int(block_of[c]), int(splits[c])) for c in np.flatnonzero(book.counts)], "cell long, block long, splits long"
    )
    packed = (
        indexed.join(F.broadcast(lookup), "cell")  # k * k lines
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("splits")))
        .groupBy("block", "part")
        .agg(F.collect_list(F.struct("vec_id", "cell", "vector")).alias("entries"))
    )
    n_queries = rows.where(is_query).count()
    walked = "query_block long, block long, query_id long, vector array<double>, visits binary"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(walked.replace("array<double>", "binary"))
        schema = schema.set(3, pa.field("vector", pa.list_(pa.float64())))
        blocks = np.unique(block_of[book.counts > 0])
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            points = matrix(batch.column(1), dim) if batch.num_rows else []
            for query, number, point in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), points):
                bits = np.zeros(book.k**2, bool)
                cells = visited_cells(point, book, enough)
                bits[cells] = True
                packed_bits = np.packbits(bits).tobytes()
                for block in np.intersect1d(np.unique(block_of[cells]), blocks).tolist():
                    for name, value in zip(schema.names, (number, block, query, point, packed_bits)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    query_blocks = max(1, math.ceil(n_queries / query_rows))
    queries = (
        rows.where(is_query)
        .withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
        .mapInArrow(walk, walked)
        .groupBy("query_block", "block")
        .agg(F.collect_list(F.struct("query_id", "vector", "visits")).alias("queries"))
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield best_of(batch.column(0)[n].values, batch.column(1)[n].values)

    def best_of(queries: pa.StructArray, entries: pa.StructArray) -> pa.RecordBatch:
        query_ids, ids = (x.field(0).to_numpy(zero_copy_only=False) for x in (queries, entries))
        wanted, points = matrix(queries.field(1), dim), matrix(entries.field(2), dim)
        bits = np.frombuffer(b"".join(queries.field(2).to_pylist()), np.uint8).reshape(len(query_ids), -1)
        seen = np.unpackbits(bits, axis=1, count=book.k**2).astype(bool)[:, entries.field(1).to_numpy(zero_copy_only=False)]
        scores = np.einsum("qd,ed->qe", wanted, points, optimize=False) if len(ids) < 2 else wanted @ points.T
        scores = np.where(seen & (ids[None, :] != query_ids[:, None]), scores, -np.inf)
        order = np.argsort(ids, kind="stable")  # smaller ids first among equals
        scores, ids = scores[:, order], ids[order]
        kept = np.argsort(-scores, axis=1, kind="stable")[:, :top]
        best = np.take_along_axis(scores, kept, 1)
        real = best > -np.inf
        columns = [np.repeat(query_ids, real.sum(1)), ids[kept][real], best[real]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    pairs = queries.join(packed, "block").select("queries", "entries").mapInArrow(rerank, spec)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score"
    )
