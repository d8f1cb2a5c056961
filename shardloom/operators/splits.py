"""Splits of an indexed dataset over workers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import uniform
from .index import expand_counts, running_before


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("bigint")


def ranged(df: DataFrame, index: str, total: Column, ranks: int, resume_at: int = 0) -> DataFrame:
    """Contiguous ranges of equal floor size, tail dropped; ``resume_at`` skips the start of each range."""
    size = _div(total, ranks)
    return (
        df.withColumn("__size", size)
        .where((F.col("__size") > 0) & (F.col(index) < F.col("__size") * ranks))
        .withColumn("rank", F.expr(f"{index} div __size"))
        .withColumn("rank_pos", F.col(index) - F.col("rank") * F.col("__size"))
        .where(F.col("rank_pos") >= resume_at)
        .drop("__size")
    )


def chunked(df: DataFrame, index: str, total: Column, ranks: int) -> DataFrame:
    """Contiguous ranges of ceiling size; nothing is dropped, the last ranges may be short or empty."""
    return (
        df.withColumn("__size", F.ceil(total / ranks).cast("bigint"))
        .withColumn("rank", F.expr(f"{index} div __size"))
        .withColumn("rank_pos", F.col(index) - F.col("rank") * F.col("__size"))
        .drop("__size")
    )


def _padded(df: DataFrame, index: str, total: Column, ranks: int, drop_last: bool) -> DataFrame:
    """Positions of an even split: rows from the start are repeated to fill up, or the tail is cut."""
    if drop_last:
        size = F.ceil((total - ranks) / ranks).cast("bigint")
        size = F.when(total % ranks == 0, _div(total, ranks)).otherwise(size)
    else:
        size = F.ceil(total / ranks).cast("bigint")
    sized = df.withColumn("__n", total).withColumn("__size", size).withColumn("__all", F.col("__size") * ranks)
    return sized.where(F.col(index) < F.col("__all")).withColumn(
        "pos", F.explode(F.expr(f"sequence(bigint({index}), __all - 1, __n)"))
    )


def local(df: DataFrame, index: str, total: Column, ranks: int, drop_last: bool = False) -> DataFrame:
    """Equal contiguous parts with padding from the start (or truncation)."""
    return (
        _padded(df, index, total, ranks, drop_last)
        .withColumn("rank", F.expr("pos div __size"))
        .drop("__n", "__size", "__all")
    )


def strided(df: DataFrame, index: str, total: Column, ranks: int, drop_last: bool = False) -> DataFrame:
    """Every ``ranks``-th row per worker, padded like ``local``."""
    return (
        _padded(df, index, total, ranks, drop_last)
        .withColumn("rank", F.pmod(F.col("pos"), F.lit(ranks)))
        .drop("__n", "__size", "__all")
    )


def round_robin_tasks(class_counts: DataFrame, workers: int, class_id: str = "class_id", count: str = "n") -> DataFrame:
    """(worker, class, image) tasks dealt out in turn, the turn going on across classes in id order.

    Only the class table is summed in order; tasks are made where they are needed.
    """
    offsets = running_before(class_counts.select(class_id, count), class_id, count, "__first")
    tasks = expand_counts(offsets, count, "image_index")
    worker = F.pmod(F.col("__first") + F.col("image_index"), F.lit(workers)).cast("int")
    return tasks.select(worker.alias("worker"), class_id, "image_index")


def balanced_mix(shards: DataFrame, parts: int, seed, group: str, url: str = "url") -> DataFrame:
    """Order of a shard list that spreads every source directory evenly over ``parts`` buckets.

    Works on the shard list: one line per shard.
    """
    in_group = Window.partitionBy(group).orderBy("__u", url)
    dealt = (
        shards.withColumn("__u", uniform(seed, F.col(url)))
        .withColumn("__pos", (F.row_number().over(in_group) - 1).cast("bigint"))
        .withColumn("bucket", F.pmod(F.col("__pos"), F.lit(parts)).cast("bigint"))
        .withColumn("round", F.expr(f"__pos div {parts}"))
    )
    turn = uniform(seed, F.col(group), F.col("bucket"), F.col("round"))
    return dealt.withColumn("turn", turn).drop("__u", "__pos")
