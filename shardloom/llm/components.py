"""Connected components by alternating large-star and small-star rounds.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one
round.  Edges of a node meet its minimum in a join, not in a group, so a hub is split like any hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has the columns ``a`` and ``b`` (long).  Loops, repeated edges and edges with a null end are
    ignored.  No edges: no rows.
    """
    clean = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialise(clean.distinct(), name)
    state = _state(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        current = materialise(_small_star(_large_star(current)), name)
        before, state = state, _state(current)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).head())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
