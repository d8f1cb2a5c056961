"""Resumable conversion and idempotent inserts as file streams that stop when the input is used up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import exists
from ..sources.files import list_files
from .metrics import run_updates


# A micro-batch reads about this much, so that a stopped run loses one batch and no more.
BYTES_PER_BATCH = 64 << 30


def open_stream(
    spark: SparkSession, path: str, pattern: str, schema: StructType, files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
):
    """Parquet files of a table (file, folder or glob) as a stream; files seen by the checkpoint are not read again.

    Batches are limited by ``files_per_batch`` where it is given, else by ``bytes_per_batch``.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    else:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_batch))
    return reader.parquet(path)


def guard_config(spark: SparkSession, state: str, config: dict) -> None:
    """Remember the conversion settings beside the checkpoint; other settings refuse to resume."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    path = f"{state}/config"
    known = spark.read.text(path).first() if exists(spark, path) else None
    if known is None:
        spark.createDataFrame([(digest,)], "value string").write.mode("overwrite").text(path)
    elif known["value"] != digest:
        raise ValueError("Conversion settings changed: resume refused")


def guard_sources(spark: SparkSession, state: str, table: str, pattern: str) -> None:
    """Inputs seen by an earlier run must be unchanged; new ones are welcome. Remembers the current listing."""
    path = f"{state}/sources"
    current = list_files(spark, table, pattern).select("path", "size_bytes", "mtime")
    if current.isEmpty():
        raise FileNotFoundError(f"No {pattern} files in {table}")
    run = 0
    if exists(spark, path):
        known = spark.read.parquet(path)
        run = known.agg(F.max("run")).first()[0] + 1
        last = known.where(F.col("run") == run - 1).drop("run")
        changed = last.join(current, ["path", "size_bytes", "mtime"], "left_anti")
        if not changed.isEmpty():
            raise ValueError(f"Converted input changed: {changed.first()['path']}")
    current.write.parquet(f"{path}/run={run}")


def convert(
    stream: DataFrame,
    out: str,
    state: str,
    config: dict,
    transform: Callable[[DataFrame], DataFrame],
    source: tuple[str, str] | None = None,
) -> DataFrame:
    """Convert everything not converted yet and return the whole output table.

    Progress is the stream checkpoint; the file sink commits a batch once.
    With ``source`` (table, pattern) a changed input refuses to resume as well.
    """
    spark = stream.sparkSession
    guard_config(spark, state, config)
    if source:
        guard_sources(spark, state, *source)
    result = transform(stream)
    query = (
        result.writeStream.format("parquet")
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def insert_absent(stream: DataFrame, out: str, state: str, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the first by ``order``, whatever batch it comes in.

    The first row of each key is kept in the state store, so no batch reads what earlier ones wrote; a batch adds
    a folder with the keys it brought or improved, and one that runs again overwrites only itself.  Put an
    arrival time in front of ``order`` where a stored row must never give way.
    """
    columns = stream.columns
    others = [c for c in columns if c not in keys]
    first = stream.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return run_updates(first.select(*columns), keys, out, state)
