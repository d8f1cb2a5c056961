"""Repeatable draws: weighted caption choice, sampling, shuffles, dropout, noise levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import SEED_EPOCH_STRIDE
from ..functions.hashing import standard_normal, uniform
from .index import expand_counts


def weighted_caption(
    scores: DataFrame, keys: list[str], threshold: float, temperature: float, seed, default: str = "prompt"
) -> DataFrame:
    """Draw one caption type per key with probability ``score^(1/T)`` among those at or above the threshold.

    ``scores`` has ``keys, ordinal, caption_type, score``.  The draw is an
    exponential race (the type with the largest ``ln(u)/w`` wins), which is the
    same distribution as a cumulative draw but combines on the map side.
    None above the threshold: the best type.  A type listed twice returns its first kept score.
    """
    weight = F.pow(F.col("score"), F.lit(1.0 / max(temperature, 0.01)))
    race = F.log(F.lit(1.0) - uniform(seed, *[F.col(k) for k in keys], F.col("ordinal"))) / weight
    kept = F.col("score") >= threshold
    per_type = scores.groupBy(*keys, "caption_type").agg(
        F.max(F.when(kept & (F.col("score") > 0), race)).alias("race"),
        F.min_by(F.when(kept, F.col("score")), F.when(kept, F.col("ordinal"))).alias("first_score"),
        F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("best"),
    )
    chosen = per_type.groupBy(*keys).agg(
        F.max_by(F.struct("caption_type", F.col("first_score").alias("score")), "race").alias("drawn"),
        F.max_by(F.struct("caption_type", F.col("best.score").alias("score")), "best").alias("fallback"),
    )
    pick = F.coalesce("drawn", "fallback")
    return chosen.select(
        *keys,
        F.coalesce(pick["caption_type"], F.lit(default)).alias("caption_type"),
        F.coalesce(pick["score"], F.lit(0.0)).alias("score"),
    )


def best_caption(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Type with the highest score, first one on ties."""
    top = F.max_by(F.struct("caption_type", "score"), F.struct("score", -F.col("ordinal")))
    return scores.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.caption_type", "b.score")


def sample_rows(df: DataFrame, key: str, count: int, seed) -> DataFrame:
    """``count`` rows without replacement; each task keeps only its own best ``count``.

    The action that runs this fails when fewer rows are eligible: a line that is there whatever is drawn
    carries the number of rows drawn into the check.
    """
    columns = df.columns
    drawn = df.withColumn("__u", uniform(seed, F.col(key))).orderBy("__u", key).limit(count).withColumn("__drawn", F.lit(True))
    line = df.sparkSession.range(1).select(F.lit(False).alias("__drawn"))
    both = drawn.drop("__u").unionByName(line, allowMissingColumns=True)
    # The rows drawn are in one place already; counting them there saves drawing twice.
    both = both.withColumn("__found", F.count_if("__drawn").over(Window.partitionBy(F.lit(0))))
    few = F.raise_error(F.lit("Not enough eligible rows")).cast("boolean")
    return both.where(F.when(F.col("__found") < count, few).otherwise(F.col("__drawn"))).select(*columns)


def epoch_seed(seed: int, epoch: int) -> int:
    return seed + SEED_EPOCH_STRIDE * epoch


def shard_shuffle(
    df: DataFrame, shard: str, row: str, seed: int, epoch: int, shuffle_first: bool = False, inner: bool = True
) -> DataFrame:
    """Sort columns of a locality-keeping shuffle: shards in random order, rows shuffled inside each.

    The first epoch keeps the shard order unless ``shuffle_first``.
    """
    s = epoch_seed(seed, epoch)
    outer = uniform(s, F.lit("shard"), F.col(shard)) if (shuffle_first or epoch > 0) else F.col(shard).cast("double")
    within = uniform(s, F.lit("row"), F.col(row)) if inner else F.col(row).cast("double")
    return df.withColumn("shard_order", outer).withColumn("row_order", within)


def in_shuffled_order(df: DataFrame, shard: str, row: str) -> DataFrame:
    """Range-partitioned sort by the columns of ``shard_shuffle``; a big shard may span partitions."""
    return df.orderBy("shard_order", shard, "row_order", row)


def chunk_shuffle(
    df: DataFrame, index: str, low: int, high: Column | int, chunk: int, seed: int, epoch: int,
    shuffle: bool = True, shuffle_first: bool = False,
) -> DataFrame:
    """``shard_shuffle`` over fixed chunks of ``[low, high)``."""
    inside = df.where((F.col(index) >= low) & (F.col(index) < high)).withColumn(
        "chunk", F.expr(f"({index} - {low}) div {chunk}")
    )
    s = epoch_seed(seed, epoch)
    outer = shuffle and (shuffle_first or epoch > 0)
    return inside.withColumn(
        "shard_order", uniform(s, F.lit("shard"), F.col("chunk")) if outer else F.col("chunk").cast("double")
    ).withColumn("row_order", uniform(s, F.lit("row"), F.col(index)) if shuffle else F.col(index).cast("double"))


def permutation(df: DataFrame, index: str, total: int, seed: int, epoch: int, name: str = "position") -> DataFrame:
    """Position of each row in the permutation of an epoch.

    Draws are uniform, so equal slices of [0, 1) hold near-equal numbers of
    rows: slices are counted, offset and ranked like index blocks.
    """
    slices = max(1, total >> 20)
    drawn = df.withColumn("__u", uniform(seed + epoch, F.col(index))).withColumn(
        "__slice", F.floor(F.col("__u") * slices).cast("bigint")
    )
    counts = drawn.groupBy("__slice").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    ranked = Window.partitionBy("__slice").orderBy("__u", index)
    return (
        drawn.join(offsets, "__slice")
        .withColumn(name, (F.col("__before") + F.row_number().over(ranked) - 1).cast("bigint"))
        .drop("__u", "__slice", "__before")
    )


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """The dataset ``times`` over, with the repeat number."""
    return expand_counts(df.withColumn("__times", F.lit(times).cast("bigint")), "__times", "repeat_no").drop("__times")


def drop_label(label: Column, probability: float, null_class: int, seed, *keys: Column) -> Column:
    return F.when(uniform(seed, *keys) < probability, F.lit(null_class)).otherwise(label)


def select_supervised(
    df: DataFrame, batch: str, key: str, noise: Column, max_noise: float, dropped: Column, probability: float,
    at_most: int, seed,
) -> DataFrame:
    """Rows that get extra supervision: little noise, not dropped, kept by chance, at most N of a batch."""
    eligible = df.where((noise <= max_noise) & ~dropped & (uniform(seed, F.col(key)) < probability)).withColumn(
        "__u", uniform(f"{seed}pick", F.col(key))
    )
    first = Window.partitionBy(batch).orderBy("__u", key)
    return eligible.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= at_most).drop("__u", "__r")


def noise_level(
    scheme: str, seed, *keys: Column, mean: float = 0.0, std: float = 1.0, mode_scale: float = 1.29
) -> Column:
    """Noise level in [0, 1] by scheme: logit_normal, mode, logit_normal_trigflow, or uniform."""
    if scheme == "logit_normal":
        z = standard_normal(seed, *keys) * std + mean
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    if scheme == "logit_normal_trigflow":
        return F.atan(F.exp(standard_normal(seed, *keys) * std + mean) / 0.5)
    u = uniform(seed, *keys)
    if scheme == "mode":
        half = F.cos(u * (math.pi / 2))
        return 1 - u - mode_scale * (half * half - 1 + u)
    return u


def shift_level(t: Column, shift: float) -> Column:
    return t / (t + (1 - t) * shift)


def noise_step(t: Column, steps: int) -> Column:
    return F.floor(t * steps).cast("int")
