"""Metric windows, live progress and failure alerts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import MAX_NAN_RUN
from ..operators.metrics import weighted_mean


def windowed_average(
    stream: DataFrame, ts: str, keys: list[str], value: str, weight: str, width: str, delay: str = "2 hours"
) -> DataFrame:
    """Weighted mean per key and time window; in append mode a window is given out once the watermark has passed it."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), *keys)
        .agg(weighted_mean(F.col(value), F.col(weight)).alias("average"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "average", "n")
    )


def worker_progress(stream: DataFrame, worker: str, kind: str, amount: str, order: str) -> DataFrame:
    """State of each worker from ready / progress / done / error events; anything else counts as unknown."""
    is_kind = {k: F.col(kind) == k for k in ("ready", "progress", "done", "error")}
    known = F.col(kind).isin(*is_kind)
    return stream.groupBy(worker).agg(
        F.sum(F.when(is_kind["progress"], F.col(amount)).otherwise(0)).cast("bigint").alias("completed"),
        F.count_if(is_kind["ready"]).alias("ready"),
        F.count_if(is_kind["done"]).alias("done"),
        F.count_if(is_kind["error"]).alias("errors"),
        F.count_if(~known).alias("unknown"),
        F.max_by(kind, order).alias("last_event"),
    )


def require_success(progress: DataFrame, total: int) -> DataFrame:
    """One line with the totals; reading it fails on errors, unknown events or a total that was not reached."""
    sums = progress.agg(
        F.sum("completed").alias("completed"), F.sum("errors").alias("errors"), F.sum("unknown").alias("unknown")
    )
    broken = F.concat_ws(
        " ", F.lit("Run failed:"), F.col("errors").cast("string"), F.lit("errors,"), F.col("unknown").cast("string"),
        F.lit("unknown events, completed"), F.col("completed").cast("string"), F.lit(f"of {total}"),
    )
    fine = (F.col("errors") == 0) & (F.col("unknown") == 0) & (F.col("completed") == total)
    return sums.where(F.when(fine, True).otherwise(F.raise_error(broken).cast("boolean")))


def nan_counts(stream: DataFrame, run: str, value: str) -> DataFrame:
    return stream.groupBy(run).agg(F.count_if(F.isnan(value)).alias("nans"))


def alerts(counts: DataFrame, limit: int = MAX_NAN_RUN) -> DataFrame:
    return counts.where(F.col("nans") > limit)


def run_append(result: DataFrame, out: str, state: str) -> DataFrame:
    spark = result.sparkSession
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def run_updates(result: DataFrame, keys: list[str], out: str, state: str) -> DataFrame:
    """Run an update-mode aggregation into a change log and return the newest line per key."""
    spark = result.sparkSession
    columns = result.columns

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(log)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    changes = spark.read.schema(result.schema.add("batch", "long")).parquet(out)
    others = [c for c in columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(*keys, "r.*").select(*columns)
