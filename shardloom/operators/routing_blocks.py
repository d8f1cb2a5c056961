"""Vectors against a prototype list of any size: blocks meet blocks, nothing whole passes through the driver.

Both sides are cut into blocks of nearby vectors, each with its centre and the largest angle to it.  By the
triangle inequality the angle between two members is at most, and at least, the angle of the centres with both
radii added, or taken away.  A pair of blocks is compared only if it could hold a better prototype than the
block that is certainly near; the best of the compared blocks are merged by an aggregate.

Blocks travel in sets that are bounded by bytes, so a vector is sent once per set of prototypes, not once per
block, and gives one line there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .vector_math import cosines, finite_vectors

#: Vectors of a block, on average.
BLOCK_ROWS = 2048
#: Vectors that blocks form around; they are drawn by hash and set what is pruned, never what is found.
PIVOTS = 256
#: The searched side is cut into about so many sets of blocks, each between these bytes.
PARTS, PART_BYTES = 96, (1 << 20, 1 << 25)
#: Bytes of the prototype blocks that one task holds.
HELD_BYTES = 1 << 24
#: Rows of both sides whose cosines are computed at once.
TILE = 128, 512
#: Slack of angles, well above the rounding of an arc cosine.
SLACK = 1e-6

_BLOCK = "block long, part long, centre array<double>, radius double, ids binary, vectors binary"
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("part", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]
)


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def draw_pivots(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors of at most ``count`` rows of (id, vec), the first in hash order."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    _, unit = finite_vectors(pd.Series([r["vec"] for r in drawn], dtype=object))
    return unit


def vector_blocks(
    rows: DataFrame, pivots: np.ndarray, name: str, block_rows: int = BLOCK_ROWS, part_bytes: int | None = None
) -> tuple[DataFrame, int]:
    """Blocks of (id, vec) around the pivots, written out, and how many numbers they use.

    Rows without a finite vector are left out.  A cell with many rows has many blocks, which rows are dealt to
    by hash; zero vectors have a cell of their own, because they are near nothing.  ``part`` is the set that a block
    travels in: of about ``part_bytes``, or a share of the whole (``PARTS``).
    """

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = pd.Series(pd.array([None] * len(vectors), "Int32"))
        some, unit = finite_vectors(vectors)
        if len(some):
            near = np.concatenate([cosines(unit[at : at + 512], pivots).argmax(axis=1) for at in range(0, len(unit), 512)])
            out.iloc[some] = np.where(np.abs(unit).max(axis=1) > 0, near, -1)
        return out

    placed = materialise(rows.select("id", "vec", cell("vec").alias("cell")).where("cell IS NOT NULL"), f"{name}-cells")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a line per pivot
    row_bytes, total = 8 * pivots.shape[1] + 8, sum(sizes.values())
    share = part_bytes or min(max(total * row_bytes // PARTS, PART_BYTES[0]), PART_BYTES[1])
    part_rows = max(1, share // row_bytes)
    first, before, lines = 0, 0, []
    for c, rows_in in sorted(sizes.items()):
        n = -(-rows_in // block_rows)
        numbers = {"first": first, "n": n, "before": before, "rows": rows_in}
        lines += [F.lit(c), F.struct(*[F.lit(v).cast("long").alias(k) for k, v in numbers.items()])]
        first, before = first + n, before + rows_in
    if not lines:
        return rows.sparkSession.createDataFrame([], _BLOCK), 0
    place = F.create_map(*lines)[F.col("cell")]
    dealt = placed.select("id", "vec", place.alias("p"), F.pmod(F.xxhash64("id"), place["n"]).alias("k"))
    part = F.expr(f"(p.before + k * p.rows div p.n) div {part_rows}")
    dealt = dealt.select("id", "vec", (F.col("p.first") + F.col("k")).alias("block"), part.alias("part"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        _, unit = finite_vectors(table.column("vec").to_pandas())
        mean = unit.mean(axis=0)
        length = math.sqrt(float((mean * mean).sum()))
        radius = math.pi
        if length > 1e-9 and np.abs(unit).max(axis=1).min() > 0:
            mean = mean / length
            radius = float(_angles(cosines(unit, mean[None]))[:, 0].max())
        ids = table.column("id").to_numpy().astype(np.int64)
        block, part = (table.column(c)[0].as_py() for c in ("block", "part"))
        line = {"block": block, "part": part, "centre": mean.tolist(), "radius": radius, "ids": ids.tobytes(), "vectors": unit.tobytes()}
        return pa.Table.from_pylist([line], schema=_BLOCK_ARROW)

    return materialise(dealt.groupBy("block").applyInArrow(build, _BLOCK), name), first


def _dealt(blocks: DataFrame, side: str, size: int) -> DataFrame:
    return blocks.withColumn(side, F.expr(f"block div {size}"))


def near_pairs(left: DataFrame, n_left: int, right: DataFrame, n_right: int, width: int = 1024) -> DataFrame:
    """(left_block, right_block) that may hold a nearest member of the right side for a member of the left.

    Centres meet centres in groups of ``width`` blocks a side.
    """
    spec = "left_block long, right_block long, least double, most double"

    def bounds(key, a: pa.Table, b: pa.Table) -> pa.Table:
        rows = {c: [] for c in ("left_block", "right_block", "least", "most")}
        if a.num_rows and b.num_rows:
            one, two = (np.array(t.column("centre").to_pylist()) for t in (a, b))
            blocks, radius = b.column("block").to_numpy(), b.column("radius").to_numpy()
            for at in range(len(one)):
                angle, r = _angles(cosines(one[at : at + 1], two))[0], a.column("radius")[at].as_py() + radius
                least, most = np.maximum(angle - r, 0.0), angle + r
                kept = np.flatnonzero(least <= most.min() + SLACK)
                rows["left_block"] += [a.column("block")[at].as_py()] * len(kept)
                rows["right_block"] += blocks[kept].tolist()
                rows["least"] += least[kept].tolist()
                rows["most"] += most[kept].tolist()
        return pa.table({"left_block": pa.array(rows["left_block"], pa.int64()), "right_block": pa.array(rows["right_block"], pa.int64()), "least": pa.array(rows["least"], pa.float64()), "most": pa.array(rows["most"], pa.float64())})

    def parts(blocks: DataFrame, own: str, other: str, n_other: int) -> DataFrame:
        last = max(0, -(-n_other // width) - 1)
        thin = _dealt(blocks.select("block", "centre", "radius"), own, width)
        return thin.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))

    met = parts(left, "l", "r", n_right).groupBy("l", "r").cogroup(parts(right, "own", "other", n_left).groupBy("other", "own"))
    found = materialise(met.applyInArrow(bounds, spec), "block-bounds")
    sure = found.groupBy("left_block").agg(F.min("most").alias("sure"))
    return found.join(sure, "left_block").where(F.col("least") <= F.col("sure") + SLACK).select("left_block", "right_block")


def all_pairs(left: DataFrame, n_right: int) -> DataFrame:
    """Every block of the left side with every number of the right side."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_right - 1)).cast("long")))
    return left.select(F.col("block").alias("left_block"), numbers.alias("right_block"))


def compare(left: DataFrame, right: DataFrame, pairs: DataFrame, fn: Callable, spec: str) -> DataFrame:
    """Rows of ``fn(ids, vectors, other ids, other vectors)``, a dict of columns, for each block of the left side and
    each set of the right, which is cut down to the blocks that are paired with it; other ids ascend.

    A task holds one set of each side, and of these only the blocks that ask and are asked for.
    """
    homes = right.select(F.col("block").alias("right_block"), F.col("part").alias("set"))
    asked = materialise(pairs.join(homes, "right_block").join(left.select(F.col("block").alias("left_block"), "part"), "left_block"), "block-pairs")
    lists = asked.groupBy("left_block", "set").agg(F.collect_list("right_block").alias("asked"))
    a = lists.join(left.select(F.col("block").alias("left_block"), "part", "ids", "vectors"), "left_block")
    groups = asked.select(F.col("right_block").alias("block"), F.col("set").alias("held"), F.col("part").alias("by")).distinct()
    b = groups.join(right.select("block", "ids", "vectors"), "block")
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in spec.split(", "))])

    def unpack(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids.as_py(), np.int64)
        return ids, np.frombuffer(vectors.as_py(), np.float64).reshape(len(ids), -1)

    def meet(key, many: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows or not many.num_rows:
            return schema.empty_table()
        blocks = held.column("block").to_pylist()
        parts = [unpack(held.column("ids")[i], held.column("vectors")[i]) for i in range(len(blocks))]
        ids, home = np.concatenate([p[0] for p in parts]), np.repeat(blocks, [len(p[0]) for p in parts])
        order = np.argsort(ids, kind="stable")
        vectors = np.concatenate([p[1] for p in parts])[order]
        ids, home = ids[order], home[order]
        del parts
        out = []
        for row in range(many.num_rows):
            wanted = many.column("asked")[row].as_py()
            own = unpack(many.column("ids")[row], many.column("vectors")[row])
            if len(wanted) == len(blocks):
                found = fn(*own, ids, vectors)
            else:
                some = np.isin(home, wanted)
                found = fn(*own, ids[some], vectors[some])
            out.append(pa.table(found, schema=schema))
        return pa.concat_tables(out)

    return a.groupBy("set", "part").cogroup(b.groupBy("held", "by")).applyInArrow(meet, spec)


def best_matches(vectors: DataFrame, prototypes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, proto, weight): the prototype (id, vec) of the largest cosine for each vector (id, vec).

    Equal cosines go to the lowest prototype.  Rows without a finite vector have no line.
    """
    pivots = draw_pivots(prototypes)
    if not len(pivots):
        raise ValueError("No prototypes")
    left, n_left = vector_blocks(vectors, pivots, "vector-blocks", block_rows)
    right, n_right = vector_blocks(prototypes, pivots, "prototype-blocks", block_rows, HELD_BYTES)

    def nearest(ids, own, protos, others) -> dict:
        proto, weight = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        for at in range(0, len(ids), TILE[0]):
            part = slice(at, at + TILE[0])
            for there in range(0, len(protos), TILE[1]):
                cos = cosines(own[part], others[there : there + TILE[1]])
                first = cos.argmax(axis=1)  # the first of equals: the lowest id
                value = cos[np.arange(len(first)), first]
                larger = value > weight[part]
                weight[part] = np.where(larger, value, weight[part])
                proto[part] = np.where(larger, protos[there + first], proto[part])
        return {"id": ids, "proto": proto, "weight": weight}

    found = compare(left, right, near_pairs(left, n_left, right, n_right), nearest, "id long, proto long, weight double")
    best = F.max_by(F.struct("proto", "weight"), F.struct("weight", -F.col("proto")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.proto", "b.weight")


def exponential_sums(vectors: DataFrame, others: DataFrame, temperature: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, total): for each vector the sum over all others of ``exp(cosine / temperature)``; each set of blocks adds one line."""
    pivots = draw_pivots(others)
    if not len(pivots):
        return vectors.select("id", F.lit(0.0).alias("total"))
    left, _ = vector_blocks(vectors, pivots, "vector-blocks", block_rows)
    right, n_right = vector_blocks(others, pivots, "prototype-blocks", block_rows, HELD_BYTES)

    def sums(ids, own, _, against) -> dict:
        total = np.zeros(len(ids))
        for at in range(0, len(ids), TILE[0]):
            for there in range(0, len(against), TILE[1]):
                cos = cosines(own[at : at + TILE[0]], against[there : there + TILE[1]])
                total[at : at + TILE[0]] += np.exp(cos / temperature).sum(axis=1)
        return {"id": ids, "total": total}

    found = compare(left, right, all_pairs(left, n_right), sums, "id long, total double")
    return found.groupBy("id").agg(F.sum("total").alias("total"))
