"""Aspect-ratio buckets and same-bucket batches."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fixed_values import ASPECT_RATIO_512
from ..functions.geometry import bucket_entry, cover_resize, nearest_bucket
from ..functions.hashing import uniform
from .index import BLOCK_ROWS, positions


def with_bucket(df: DataFrame, height: str, width: str, table=ASPECT_RATIO_512) -> DataFrame:
    """Nearest bucket by height/width: ``ratio``, ``bucket_h``, ``bucket_w``, ``bucket_no``."""
    near = nearest_bucket(F.col(height).cast("double") / F.col(width), table)
    found = df.withColumn("bucket_no", near)
    return found.select(
        *df.columns, *[c.alias(n) for n, c in bucket_entry(F.col("bucket_no"), table).items()], "bucket_no"
    )


def with_resize(df: DataFrame, height: str, width: str) -> DataFrame:
    """Resize size and centre-crop offsets that bring a sample onto its bucket."""
    h, w = cover_resize(F.col(height), F.col(width), F.col("bucket_h"), F.col("bucket_w"))
    return (
        df.withColumn("resize_h", h)
        .withColumn("resize_w", w)
        .withColumn("crop_top", F.bround((F.col("resize_h") - F.col("bucket_h")) / 2.0).cast("int"))
        .withColumn("crop_left", F.bround((F.col("resize_w") - F.col("bucket_w")) / 2.0).cast("int"))
    )


def histogram(df: DataFrame, bucket: str = "ratio", least: int = 1) -> DataFrame:
    """Samples per bucket; buckets below ``least`` samples are not available."""
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= least)


def same_bucket_batches(
    df: DataFrame,
    index: str,
    batch_size: int,
    rank: str = "rank",
    bucket: str = "ratio",
    drop_last: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batch number of each row within (rank, bucket), in arrival order.

    ``full`` tells batches that filled up from the flushed rest.
    """
    placed = positions(df, index, (rank, bucket), "__pos", "__size", block_rows)
    batched = placed.withColumn("batch_no", F.expr(f"__pos div {batch_size}")).withColumn(
        "full", (F.col("batch_no") + 1) * batch_size <= F.col("__size")
    )
    if drop_last:
        batched = batched.where("full")
    return batched.drop("__pos", "__size")


def collate(batched: DataFrame, index: str, fields: list[str], rank: str = "rank", bucket: str = "ratio") -> DataFrame:
    """One row per batch with parallel arrays in arrival order; a group never exceeds the batch size.

    ``emit_at`` is the index of the last member: full batches come out in that order,
    flushed rests come after them.
    """
    packed = batched.groupBy(rank, bucket, "batch_no", "full").agg(
        F.sort_array(F.collect_list(F.struct(index, *fields))).alias("__rows"), F.max(index).alias("emit_at")
    )
    return packed.select(
        rank,
        bucket,
        "batch_no",
        "full",
        "emit_at",
        *[F.col(f"__rows.{f}").alias(f) for f in (index, *fields)],
    )


def collate_micro(batched: DataFrame, index: str, micro: str, rank: str = "rank", bucket: str = "ratio") -> DataFrame:
    """One row per batch out of rows that hold a list of samples each: the lists are joined in arrival order first.

    ``micro`` is an array of structs.  Every field becomes a parallel array, a nested struct a struct of arrays, so no
    field has to be named.  A row with a null or empty list adds nothing, a null sample in a list is left out.
    ``samples`` is the number of samples; a group never holds more than the lists of one batch.
    """
    element = batched.schema[micro].dataType.elementType

    def picker(path: tuple[str, ...]):
        return lambda sample: functools.reduce(lambda c, name: c[name], path, sample)

    def stacked(samples: Column, fields: list[T.StructField], path: tuple[str, ...] = ()) -> list[Column]:
        out = []
        for f in fields:
            own = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out.append(F.struct(*stacked(samples, f.dataType.fields, own)).alias(f.name))
            else:
                out.append(F.transform(samples, picker(own)).alias(f.name))
        return out

    packed = batched.groupBy(rank, bucket, "batch_no", "full").agg(
        F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.array_compact(F.coalesce(micro, F.array().cast(batched.schema[micro].dataType))).alias("m")))).alias("__rows"),
        F.max(index).alias("emit_at"),
    )
    flat = packed.withColumn("__flat", F.flatten(F.transform("__rows", lambda r: r["m"])))
    return flat.select(
        rank, bucket, "batch_no", "full", "emit_at", F.size("__flat").alias("samples"), *stacked(F.col("__flat"), element.fields)
    )


def substitutes(df: DataFrame, index: str, bad: Column, seed, bucket: str = "ratio", block_rows: int = BLOCK_ROWS):
    """A good sample drawn uniformly from the same bucket for every bad one; null when the bucket has none.

    Good rows get a dense position in their bucket, a bad row draws a position:
    an equi join, whatever the size of the bucket.
    """
    flagged = df.select(F.col(index), F.col(bucket), bad.alias("__bad"))
    good = positions(flagged.where(~F.col("__bad")), index, (bucket,), "__k", block_rows=block_rows)
    sizes = flagged.where(~F.col("__bad")).groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    wrong = flagged.where("__bad").join(sizes, bucket, "left")
    wrong = wrong.withColumn("__k", F.floor(uniform(seed, F.col(index)) * F.col("__n")).cast("bigint"))
    pool = good.select(bucket, "__k", F.col(index).alias("replacement"))
    return wrong.join(pool, [bucket, "__k"], "left").select(index, bucket, "replacement")


def next_good(df: DataFrame, index: str, bad: Column, tries: int = 10, dense: bool = False) -> DataFrame:
    """Next good index within ``tries`` steps of every bad one, null when there is none.

    Where indices are ``dense`` from 0, the steps only meet the bad rows and the row count, not all good rows.
    """
    flagged = df.select(F.col(index), bad.alias("__bad"))
    steps = flagged.where("__bad").select(
        F.col(index), F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("__step")
    ).withColumn("__try", F.col(index) + F.col("__step"))
    if dense:
        total = df.agg(F.count(F.lit(1))).scalar()
        wrong = flagged.where("__bad").select(F.col(index).alias("__try"))
        landed = steps.where(F.col("__try") < total).join(wrong, "__try", "left_anti")
    else:
        landed = steps.join(flagged.where(~F.col("__bad")).select(F.col(index).alias("__try")), "__try")
    hit = landed.groupBy(index).agg(F.min("__try").alias("next_index"))
    return flagged.where("__bad").select(index).join(hit, index, "left")
