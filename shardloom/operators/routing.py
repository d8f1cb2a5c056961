"""Assignment of vectors to prototypes by cosine, usage, centroids and contrastive score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import CONTRASTIVE_TEMPERATURE
from ..functions.vectors import cosine
from ..session import materialise
from . import routing_blocks
from .vector_math import cosines, finite_vectors

# Prototypes are shipped with the tasks in chunks of this many.
CHUNK_PROTOTYPES = 4096
# A prototype list up to this size is shipped; a larger one stays in blocks on the executors.
MAX_SHIPPED_BYTES = 16 << 20


def _listed(prototypes: DataFrame, vec: str) -> DataFrame:
    """Prototypes as (id, vec); rows without id or without a vector of finite numbers are none."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return prototypes.where(F.col("proto").isNotNull() & F.col(vec).isNotNull() & finite).select(
        F.col("proto").cast("long").alias("id"), F.col(vec).alias("vec")
    )


def is_large(prototypes: DataFrame, vec: str = "vec") -> bool:
    """Whether a prototype list is above ``MAX_SHIPPED_BYTES``."""
    size = _listed(prototypes, vec).agg(F.coalesce(F.sum(8 + 8 * F.size("vec")), F.lit(0))).first()[0]
    return size > MAX_SHIPPED_BYTES


def prototype_chunks(prototypes: DataFrame, vec: str = "vec", chunk: int = CHUNK_PROTOTYPES) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``chunk`` prototypes each, by id, of a list that :func:`is_large` has found small."""
    rows = _listed(prototypes, vec).orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], dtype="int64")
    _, matrix = finite_vectors(pd.Series([r["vec"] for r in rows], dtype=object))
    return [(ids[i : i + chunk], matrix[i : i + chunk]) for i in range(0, len(ids), chunk)]


def _best_of(chunks: list[tuple[np.ndarray, np.ndarray]]):
    """Arrow-batched top-1 cosine over all chunks; a later chunk wins only by a larger cosine."""

    @F.pandas_udf("struct<proto:bigint,weight:double>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            some, unit = finite_vectors(vectors)
            weight, proto = np.full(len(some), -np.inf), np.zeros(len(some), np.int64)
            for at in range(0, len(some), 512):
                part = slice(at, at + 512)
                for ids, matrix in chunks:
                    cos = cosines(unit[part], matrix)
                    first = cos.argmax(axis=1)  # the first of equals: the lowest id
                    value = cos[np.arange(len(first)), first]
                    larger = value > weight[part]
                    weight[part] = np.where(larger, value, weight[part])
                    proto[part] = np.where(larger, ids[first], proto[part])
            out = pd.DataFrame({"proto": pd.array([None] * len(vectors), "Int64"), "weight": pd.array([None] * len(vectors), "Float64")})
            out.loc[some, "proto"], out.loc[some, "weight"] = proto, weight
            yield out

    return best


def _in_blocks(vectors: DataFrame, prototypes: DataFrame, vec: str, is_null: Column, block_rows: int) -> DataFrame:
    """``vectors`` with the struct ``__r`` of the best prototype, found block against block.

    Rows get a number that their written table keeps, because ``key`` may repeat.
    """
    numbered = materialise(vectors.withColumn("__id", F.monotonically_increasing_id()).withColumn("__null", is_null), "vectors")
    asked = numbered.where("NOT __null").select(F.col("__id").alias("id"), F.col(vec).alias("vec"))
    best = routing_blocks.best_matches(asked, _listed(prototypes, "vec"), block_rows)
    found = best.select(F.col("id").alias("__id"), F.struct("proto", "weight").alias("__r"))
    return numbered.join(found, "__id", "left").drop("__id", "__null")


def assign(
    vectors: DataFrame,
    prototypes: DataFrame,
    key: str,
    vec: str = "vec",
    null_row: Column | None = None,
    null_proto: int | None = None,
    max_shipped: int = CHUNK_PROTOTYPES,
    in_blocks: bool | None = None,
    block_rows: int = routing_blocks.BLOCK_ROWS,
) -> DataFrame:
    """Top-1 prototype by cosine, the raw cosine as weight; ties go to the lowest prototype id.

    Null-class rows go to the extra index ``null_proto`` with weight 1 and ``routed`` false; a vector that is
    null or holds a null or a number that is not finite has no prototype and is not routed.  ``key`` may repeat.

    The list (``proto, vec``) is measured first.  A small one is shipped in chunks of ``max_shipped`` and the vectors
    are not shuffled; one above ``MAX_SHIPPED_BYTES`` meets the vectors in blocks (see ``routing_blocks``).
    ``in_blocks`` overrides the measure.  The rows are the same, to the last bit of the weight.
    """
    is_null = F.coalesce(null_row, F.lit(False)) if null_row is not None else F.lit(False)
    if is_large(prototypes) if in_blocks is None else in_blocks:
        out = _in_blocks(vectors, prototypes, vec, is_null, block_rows)
    else:
        chunks = prototype_chunks(prototypes, chunk=max_shipped)
        if not chunks:
            raise ValueError("No prototypes")
        out = vectors.withColumn("__r", _best_of(chunks)(F.col(vec)))
    return out.select(
        *vectors.columns,
        F.when(is_null, F.lit(null_proto)).otherwise(F.col("__r.proto")).cast("bigint").alias("proto"),
        F.when(is_null, F.lit(1.0)).otherwise(F.col("__r.weight")).alias("weight"),
        (~is_null & F.col("__r.proto").isNotNull()).alias("routed"),
    )


def usage(assigned: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Vectors and mean weight per prototype; inactive prototypes stay with zero."""
    used = assigned.where("routed").groupBy("proto").agg(
        F.count(F.lit(1)).alias("vectors"), F.avg("weight").alias("mean_weight")
    )
    zero = F.lit(0).cast("bigint")
    return prototypes.select(F.col("proto").cast("bigint")).join(used, "proto", "left").select(
        "proto",
        F.coalesce("vectors", zero).alias("vectors"),
        "mean_weight",
        (F.coalesce("vectors", zero) > 0).alias("active"),
    )


def centroids(assigned: DataFrame, dims: int, vec: str = "vec") -> DataFrame:
    """Mean vector of the rows routed to each active prototype.

    One partial average per dimension: the shuffle carries one line per task and
    prototype, so a hot prototype costs no more than any other.
    """
    means = [F.avg(F.col(vec)[i].cast("double")).alias(f"__d{i}") for i in range(dims)]
    rows = assigned.where("routed").groupBy("proto").agg(*means)
    return rows.select("proto", F.array(*[F.col(f"__d{i}") for i in range(dims)]).alias("centroid"))


def contrastive_score(
    centres: DataFrame, prototypes: DataFrame, temperature: float = CONTRASTIVE_TEMPERATURE, scale: float = 1.0,
    in_blocks: bool | None = None, block_rows: int = routing_blocks.BLOCK_ROWS,
) -> DataFrame:
    """Softmax cross-entropy of prototype-to-centroid cosines over the active prototypes; 0 below two.

    Every active prototype meets every centroid, as the score asks.  Small lists of centroids are shipped; large
    ones meet the prototypes block against block, a partial sum of exponentials per pair of blocks.
    """
    centres = materialise(centres, "centres")  # a line per prototype, read three times below
    active = prototypes.select(F.col("proto").cast("bigint"), "vec").join(centres, "proto")
    own = cosine(F.col("vec"), F.col("centroid")) / temperature
    if is_large(centres, "centroid") if in_blocks is None else in_blocks:
        active = materialise(active, "active")
        sums = routing_blocks.exponential_sums(
            active.select(F.col("proto").alias("id"), "vec"), _listed(centres, "centroid"), temperature, block_rows
        )
        losses = active.join(sums, F.col("proto") == F.col("id")).select((F.log("total") - own).alias("loss"))
    else:
        chunks = prototype_chunks(centres, "centroid")

        @F.pandas_udf("double")
        def exp_sum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                some, unit = finite_vectors(vectors)
                total = np.zeros(len(vectors))
                for at in range(0, len(some), 512):
                    for _, matrix in chunks:
                        total[some[at : at + 512]] += np.exp(cosines(unit[at : at + 512], matrix) / temperature).sum(axis=1)
                yield pd.Series(total)

        losses = active.select((F.log(exp_sum("vec")) - own).alias("loss"))
    n = F.count(F.lit(1))
    return losses.agg(
        n.alias("active"), F.when(n < 2, F.lit(0.0)).otherwise(F.avg("loss") * scale).alias("score")
    )
