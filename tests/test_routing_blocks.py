"""Routing over a prototype list in blocks: the same rows as over a shipped list, and pruned where it can be."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import routing, routing_blocks
from shardloom.operators.vector_math import unit_rows

VECTORS = "vec_id long, label int, vec array<float>, proto string, weight string, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, None if v is None else [float(x) for x in v], "p", "w", 1) for i, k, v in rows], VECTORS)


def prototypes(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "proto long, vec array<float>")


def lines(df, weight="weight"):
    return sorted(((r.vec_id, r.label, r[-3], r[-2], r[-1]) for r in df.collect()), key=str)


def both(spark, given, protos, block_rows=7, **kw):
    given = given.drop("proto", "weight")
    shipped = lines(routing.assign(given, protos, "vec_id", in_blocks=False, **kw))
    blocked = lines(routing.assign(given, protos, "vec_id", in_blocks=True, block_rows=block_rows, **kw))
    assert shipped == blocked
    return blocked


def test_blocks_give_the_rows_of_the_shipped_list(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 8))
    near = lambda n: centres[rnd.integers(0, 6, n)] + 0.2 * rnd.normal(size=(n, 8))
    rows = [(i, i % 5, v) for i, v in enumerate(near(200))] + [(i, 1, v) for i, v in enumerate(rnd.normal(size=(60, 8)))]
    rows += [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [float("nan")] + [1.0] * 7), (903, 1, [float("inf")] * 8), (904, 0, None)]
    protos = [(i, v) for i, v in enumerate(near(90))] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    protos += [(600 + i, rows[3][2]) for i in range(5)]  # ties: all point where vector 3 points
    got = both(spark, vectors(spark, rows), prototypes(spark, protos), null_row=F.col("label") == 0, null_proto=-1)
    assert [r[2:] for r in got if r[0] == 904] == [(-1, 1.0, False)] and [r[2:] for r in got if r[0] == 900] == [(None, None, False)]
    assert [r[2] for r in got if r[:2] == (3, 3)] == [600]
    assert all(r[2:] == (None, None, False) for r in got if r[0] in (902, 903))
    assert len(got) == len(rows)


def test_ties_across_blocks_go_to_the_lowest_prototype(spark):
    same = [(i, [1.0, 1.0]) for i in range(40, 0, -1)]
    rows = [(1, 1, [2.0, 2.0]), (2, 1, [0.0, 0.0]), (3, 1, [-1.0, -1.0])]
    got = both(spark, vectors(spark, rows), prototypes(spark, same), block_rows=3)
    assert [r[2] for r in got] == [1, 1, 1]


def test_empty_sides(spark):
    some = prototypes(spark, [(1, [1.0, 0.0])])
    assert routing.assign(vectors(spark, []).drop("proto", "weight"), some, "vec_id", in_blocks=True).count() == 0
    for way in (True, False):
        with pytest.raises(ValueError, match="No prototypes"):
            routing.assign(vectors(spark, [(1, 1, [1.0, 0.0])]), prototypes(spark, [(1, None)]), "vec_id", in_blocks=way)


def test_far_blocks_are_not_compared(spark):
    rnd = np.random.default_rng(2)
    centres = 10 * np.eye(16)[:8]
    protos = spark.createDataFrame([(i, (centres[i % 8] + 0.05 * rnd.normal(size=16)).tolist()) for i in range(800)], "id long, vec array<double>")
    pivots = routing_blocks.draw_pivots(protos, 64)
    right, n = routing_blocks.vector_blocks(protos, pivots, "right", 25)
    pairs = routing_blocks.near_pairs(right, n, right, n, width=16)
    assert right.count() > 16 and pairs.count() < right.count() ** 2 / 4
    assert right.agg(F.max("radius")).first()[0] < 0.5


def test_pairs_never_lose_a_nearest_member(spark):
    rnd = np.random.default_rng(3)
    data = {side: unit_rows(rnd.normal(size=(n, 4)) * rnd.choice([0.1, 1, 3], size=(1, 4))) for side, n in (("a", 300), ("b", 150))}
    frames = {s: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>") for s, m in data.items()}
    pivots = routing_blocks.draw_pivots(frames["b"], 12)
    a, n_a = routing_blocks.vector_blocks(frames["a"], pivots, "a", 9)
    b, n_b = routing_blocks.vector_blocks(frames["b"], pivots, "b", 5)
    home = lambda blocks: {i: r.block for r in blocks.collect() for i in np.frombuffer(r.ids, np.int64).tolist()}
    in_a, in_b = home(a), home(b)
    kept = {tuple(r) for r in routing_blocks.near_pairs(a, n_a, b, n_b, width=4).collect()}
    best = (data["a"] @ data["b"].T).argmax(axis=1)
    assert all((in_a[i], in_b[int(j)]) in kept for i, j in enumerate(best))


def test_large_lists_go_to_blocks_by_size(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    given = vectors(spark, [(i, 1, v) for i, v in enumerate(rnd.normal(size=(50, 4)))]).drop("proto", "weight")
    protos = prototypes(spark, [(i, v) for i, v in enumerate(rnd.normal(size=(30, 4)))])
    small = lines(routing.assign(given, protos, "vec_id"))
    monkeypatch.setattr(routing, "MAX_SHIPPED_BYTES", 100)
    monkeypatch.setattr(routing, "prototype_chunks", None)  # nothing may come through the driver
    assert lines(routing.assign(given, protos, "vec_id")) == small
    assigned = routing.assign(given, protos, "vec_id")
    score = routing.contrastive_score(routing.centroids(assigned, 4), protos, block_rows=6).first()
    monkeypatch.undo()
    plain = routing.contrastive_score(routing.centroids(assigned, 4), protos).first()
    assert score.active == plain.active > 5 and abs(score.score - plain.score) < 1e-9
