"""Near duplicates among vectors by sorted projection passes.

Every pass has its own random hyperplanes; the signs of a vector are its bit string, and the vectors of a pass are
put in order by it.  Along that order each is compared with the window of vectors that follow it.  Vectors that
share the leading bits are a run.  A run that the window does not cover, because it is longer or cut by the border
of a task, is compared in full, block against block.  The leading bits grow with the number of vectors and the
passes with these bits, so a pair at the cosine shares a run with the same probability whatever lies around it.
Pairs that reach the cosine give forests, and those of all passes give components.  The links inside a component
are then counted in full, block against block, so a group of any size is counted whole; no pair is a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .components import connected_components
from .vectors import bytes_of, dimensions, finite, near, points_of, usable

KEY_BITS = 60


def sign_keys(points: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """(passes, rows): concatenated signs of random projections as integers."""
    planes = np.random.default_rng(seed).standard_normal((passes, bits, points.shape[1]))
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return np.stack([((points @ p.T) >= 0) @ weights for p in planes])


def plan_passes(n: int, threshold: float, miss: float, run_rows: int) -> tuple[int, int]:
    """(passes, bits): runs of about ``run_rows`` evenly spread vectors; a pair at ``threshold`` shares none with probability ``miss``."""
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, n) / run_rows))))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return (1 if meet >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-meet))), bits


def block_forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning star of each component of the symmetric links ``linked``."""
    own = np.flatnonzero(linked.any(1))
    linked, label = linked[np.ix_(own, own)], np.arange(len(own))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(own)).min(1, initial=len(own)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    apart = label != np.arange(len(own))
    return ids[own[apart]], ids[own[label[apart]]]


def group_starts(table: pa.Table, names: list[str]) -> np.ndarray:
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names])
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])) if table.num_rows else np.array([], int)


def by_group(batches: Iterator[pa.RecordBatch], names: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on sorted rows and the places where their groups start; a group is never cut."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        starts = group_starts(table, names)
        # the last group may go on in the next batch
        if len(starts) > 1:
            yield work(table.slice(0, starts[-1]), starts[:-1])
        rest = table.slice(starts[-1]) if len(starts) else table
    if rest is not None and rest.num_rows:
        yield work(rest, group_starts(rest, names))


def window_links(ids: np.ndarray, points: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links of the first ``window`` vectors with the ``window`` that follow each of them."""
    i, j = np.nonzero(near(points[:window], points, threshold))
    meant = (j > i) & (j - i <= window) & (ids[i] != ids[j])
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[i[meant], j[meant]] = linked[j[meant], i[meant]] = True
    return block_forest(ids, linked) if meant.any() else (ids[:0], ids[:0])


class LongRuns:
    """Rows of the runs that the window does not cover, as the sorted rows of a task pass by."""

    def __init__(self, window: int):
        self.window, self.run, self.held, self.size, self.open = window, None, [], 0, True

    def _end(self) -> list[tuple[tuple[int, int], np.ndarray]]:
        return [(self.run, ids) for ids in self.held] if self.open else []

    def take(self, number: np.ndarray, run: np.ndarray, ids: np.ndarray) -> list[tuple[tuple[int, int], np.ndarray]]:
        """Lines (run, ids) that are known to belong to such runs by now; the first run of a task is one of them."""
        out: list[tuple[tuple[int, int], np.ndarray]] = []
        cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(run) != 0)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = (int(number[a]), int(run[a]))
            if own != self.run:
                if self.open:
                    out += self._end()
                self.open, self.run, self.held, self.size = self.run is None, own, [], 0
            self.held.append(ids[a:b])
            self.size += b - a
            self.open = self.open or self.size > self.window + 1
            if self.open:
                out += self._end()
                self.held = []
        return out

    def finish(self) -> list[tuple[tuple[int, int], np.ndarray]]:
        """The last run may go on in the next task."""
        self.open = True
        return self._end()


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    miss: float = 1e-4, run_rows: int = 256, window: int = 512, block_rows: int = 512, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    A pair at exactly ``threshold`` is left uncompared with probability ``miss``, a closer one with less.
    ``n_links`` counts the other vectors at a cosine of at least ``threshold`` in the same component;
    ``component_id`` is the smallest id reachable by links.  Equal vectors are one while comparing and count
    as links of each other.  Cosines near ``threshold`` are summed in doubles, dimension by dimension, so a pair is
    judged alike in every block.  Vectors that are null, zero, or hold null or non-finite components link with
    nothing, and none links with one of another dimension; rows without id are kept alone.  Repeated ids count as
    vectors of their own and share a component among those of their dimension.  Other columns are ignored.
    """
    settings = (threshold, id_col, vector_col, miss, run_rows, window, block_rows, seed)
    dims = dimensions(vectors, id_col, vector_col)
    rest = dims[1:]
    of = F.coalesce(F.size(F.col(vector_col)), F.lit(-1))
    common = vectors.where(~of.isin(rest)) if rest else vectors
    found = _of_dimension(common, dims[0] if dims else 0, *settings)
    for dim in rest:
        found = found.unionByName(_of_dimension(vectors.where(of == dim), dim, *settings))
    return found


def _of_dimension(
    vectors: DataFrame, dim: int, threshold: float, id_col: str, vector_col: str, miss: float, run_rows: int, window: int, block_rows: int, seed: int
) -> DataFrame:
    """:func:`near_duplicates` where all vectors that take part have one dimension."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows, dim = usable(vectors, id_col, vector_col, dim)
    out_id = F.col(id_col).cast("long").alias("vec_id")
    if dim == 0:
        return vectors.select(out_id, F.lit(0).cast("long").alias("n_links"), out_id.alias("component_id"), F.lit(True).alias("kept"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), bytes_of(batch.column(1), dim, kind)], ["vec_id", "vector"])

    keyed = rows.mapInArrow(pack, "vec_id long, vector binary").withColumn("content", F.sha2("vector", 256))
    classes = materialise(
        keyed.groupBy("content").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "vector-classes"
    )
    passes, bits = plan_passes(classes.count(), threshold, miss, run_rows)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for number, key in enumerate(sign_keys(points_of(batch.column(1), dim, kind), passes, KEY_BITS, seed)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), number, np.int32)), pa.array(key), *batch.columns], ["pass", "key", "rep", "vector"]
                )

    projected = classes.select("rep", "vector").mapInArrow(project, "pass int, key long, rep long, vector binary")
    ordered = projected.repartitionByRange("pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
    found_spec = "pass int, run long, a long, b long"

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b)], ["pass", "run", "a", "b"])

    def long_runs(lines: list[tuple[tuple[int, int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (number, run), ids in lines:
            n = len(ids)
            columns = [pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, run)), pa.array(ids), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["pass", "run", "a", "b"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, ids, points = LongRuns(window), np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            number, key, own = (batch.column(i).to_numpy() for i in range(3))
            yield from long_runs(runs.take(number, key >> (KEY_BITS - bits), own))
            ids, points = np.concatenate([ids, own]), np.concatenate([points, points_of(batch.column(3), dim, kind)])
            done = 0
            while len(ids) - done >= 2 * window:
                yield edges(*window_links(ids[done : done + 2 * window], points[done : done + 2 * window], window, threshold))
                done += window
            ids, points = ids[done:], points[done:]
        yield from long_runs(runs.finish())
        for at in range(0, len(ids), window):
            yield edges(*window_links(ids[at : at + 2 * window], points[at : at + 2 * window], window, threshold))

    found = materialise(ordered.mapInArrow(along, found_spec), "vector-passes")

    # runs that the window did not cover meet themselves, or their parts each other
    left = found.where("b is null").select("pass", "run", F.col("a").alias("rep"))
    sizes = left.groupBy("pass", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("pass", "run", F.ceil(F.col("n") / (2 * block_rows)).cast("int").alias("n_parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other")
    dealt = left.join(sizes, ["pass", "run"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int"))
    dealt = dealt.select("pass", "run", "part", "rep", "n_parts", other).where("n_parts = 1 or part <> other").select(
        "pass", "run", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep"
    )
    names = ["pass", "run", "i", "j"]
    blocks = dealt.join(classes.select("rep", "vector"), "rep").repartition(*names).sortWithinPartitions(*names, "rep")

    def edges_of(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        points, ids = points_of(table.column("vector"), dim, kind), table.column("rep").to_numpy()
        forests = [(ids[:0], ids[:0])]
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            linked = near(points[a:b], points[a:b], threshold)
            linked &= ids[a:b, None] != ids[None, a:b]
            forests.append(block_forest(ids[a:b], linked))
        a, b = (np.concatenate(x) for x in zip(*forests))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_group(batches, names, edges_of)

    links = found.where("b is not null").select("a", "b").unionByName(blocks.mapInArrow(compare, "a long, b long"))
    found = materialise(connected_components(links, "vector-links"), "vector-components")
    grouped = found.withColumnRenamed("node", "rep").join(classes.drop("content"), "rep")
    parts = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select(
        "component", F.ceil(F.col("n") / block_rows).cast("int").alias("n_parts")
    )
    placed = grouped.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int"))
    # a block meets itself and every other block of its component; a component that fits one block meets itself only
    other = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("other")
    paired = placed.select("component", "rep", "copies", "vector", "part", other).select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "copies", "vector"
    )
    counted = paired.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "part", "rep")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_group(batches, ["component", "i", "j"], links_of)

    def links_of(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        points = points_of(table.column("vector"), dim, kind)
        copies, part = (table.column(c).to_numpy() for c in ("copies", "part"))
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        links = np.zeros(len(copies), np.int64)
        for a, b in zip(starts, [*starts[1:], len(copies)]):
            linked = near(points[a:b], points[a:b], threshold)
            if i[a] != j[a]:
                linked &= part[a:b, None] != part[None, a:b]
            np.fill_diagonal(linked, False)
            links[a:b] = linked @ copies[a:b]
        return pa.RecordBatch.from_arrays([table.column("rep").combine_chunks(), pa.array(links)], ["rep", "links"])

    links = counted.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    reps = classes.join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    results = materialise(reps.select("content", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "vector-results")
    linked = keyed.select("vec_id", "content").join(results, "content").select(
        "vec_id",
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"),
    )
    takes_part = finite(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) == dim)
    alone = vectors.where(~F.coalesce(takes_part, F.lit(False))).select(
        out_id, F.lit(0).cast("long").alias("n_links"), out_id.alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)
