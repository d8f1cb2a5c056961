"""Metric series: weighted means, rolling statistics, shares, progress, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import BUCKET_CACHE_ITEM_BYTES, BUCKET_CACHE_THRESHOLD_BYTES, MAX_NAN_RUN
from ..functions.names import format_duration
from .index import BLOCK_ROWS, positions


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate ``sum(v*w) / sum(w)``; without any weight there is no mean (NaN)."""
    total = F.sum(weight)
    return F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(value * weight) / F.nullif(total, F.lit(0)))


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key; tasks cut to ``n`` per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n).drop("__r")


def weighted_average(df: DataFrame, keys: list[str], order: str, value: str, weight: str, n: int = 0) -> DataFrame:
    """Count-weighted mean of the last ``n`` values per metric; 0 means all."""
    window = df if n == 0 else last_n(df, keys, order, n)
    return window.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias("average"))


def rolling_stats(
    df: DataFrame, keys: list[str], step: str, value: str, window: int = 100, warmup: int = 0
) -> DataFrame:
    """Statistics of the last ``window`` values after the warm-up steps; ``count`` covers every value."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    recent = last_n(df.where(F.col(step) >= warmup), keys, step, window)
    stats = recent.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.percentile(value, 0.5).alias("median"),
        F.sum(value).alias("total"),
    )
    return counts.join(stats, keys)


def timer_report(stats: DataFrame, total_timer: str, workers: int, name: str = "name") -> DataFrame:
    """Share of the total timer's mean per timer, step rate and rate over all workers.

    ``stats`` has one line per timer; without the total timer its mean counts as 1.
    """
    whole = stats.where(F.col(name) == total_timer).agg(F.max("mean")).scalar()
    step = F.coalesce(whole, F.lit(1.0))
    return stats.select(
        name,
        (F.col("mean") * 1000).alias("mean_ms"),
        (F.col("std") * 1000).alias("std_ms"),
        (F.col("mean") / step * 100).alias("percent"),
        F.when(F.col("mean") > 0, 1 / F.col("mean")).otherwise(0.0).alias("per_sec"),
        F.when(F.col("mean") > 0, workers / F.col("mean")).otherwise(0.0).alias("global_per_sec"),
    )


def reduce_over_workers(df: DataFrame, step: str, loss: str, samples: str) -> DataFrame:
    """Per step: mean of the workers' losses, sum of their sample counts."""
    return df.groupBy(step).agg(F.avg(loss).alias("loss"), F.sum(samples).alias("samples"))


def progress(done: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Percent, rate and remaining time of a running job."""
    rate = F.when(elapsed > 0, done / elapsed).otherwise(F.lit(0.0))
    eta = F.when(rate > 0, (total - done) / rate)
    return {
        "percent": done * 100.0 / total,
        "rate": rate,
        "eta": format_duration(eta),
    }


def moving_average(
    df: DataFrame, series: str, order: str, value: str, decay: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Final exponential moving average per series: ``e = d*e + (1-d)*x``, starting at the first value.

    The recurrence is linear, so the result is a weighted sum by position: a
    series of any length combines on the map side and is never collected.
    """
    placed = positions(df.select(series, order, value), order, (series,), "__pos", "__n", block_rows)
    age = F.col("__n") - 1 - F.col("__pos")
    first = F.when(F.col("__pos") == 0, F.pow(F.lit(decay), age)).otherwise(F.pow(F.lit(decay), age) * (1 - decay))
    return placed.groupBy(series).agg(F.sum(first * F.col(value)).alias("ema"), F.count(F.lit(1)).alias("n"))


def nan_runs(df: DataFrame, run: str, value: str, limit: int = MAX_NAN_RUN) -> DataFrame:
    """NaN values per run; a run above the limit fails."""
    return df.groupBy(run).agg(F.count_if(F.isnan(value)).alias("nans")).withColumn("failed", F.col("nans") > limit)


def audit_records(df: DataFrame, rank: str, step: str, n: int = 30) -> DataFrame:
    """First ``n`` records per rank in step order, with their number."""
    first = Window.partitionBy(rank).orderBy(step)
    return df.withColumn("record_no", F.row_number().over(first)).where(F.col("record_no") <= n)


def step_windows(df: DataFrame, keys: list[str], step: str, value: str, weight: str, every: int) -> DataFrame:
    """Weighted mean per logging interval: intervals end at the first step and at every multiple of ``every``."""
    window = F.when(F.col(step) <= 1, F.lit(0)).otherwise(F.ceil(F.col(step) / every)).cast("bigint")
    return df.groupBy(*keys, window.alias("interval")).agg(
        weighted_mean(F.col(value), F.col(weight)).alias("average"), F.count(F.lit(1)).alias("n")
    )


def shard_totals(shards: DataFrame) -> DataFrame:
    """Files, samples and bytes of a shard list; a missing size counts as nothing."""
    return shards.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("nsamples").alias("samples"),
        F.sum(F.coalesce("filesize", F.lit(0))).alias("bytes"),
    )


def outcome_counters(df: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """How many rows were new, existed already, or were skipped."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(outcome) == kind).alias(kind) for kind in ("new", "existing", "skipped")]
    )


def run_summary(samples: DataFrame, bucket: str) -> DataFrame:
    """Samples, buckets and where a bucket cache of that size belongs."""
    size = F.count(F.lit(1)) * F.lit(BUCKET_CACHE_ITEM_BYTES).cast("bigint")
    return samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct(bucket).alias("buckets"),
        size.alias("cache_bytes"),
        F.when(size > BUCKET_CACHE_THRESHOLD_BYTES, "file").otherwise("memory").alias("cache_kind"),
    )
