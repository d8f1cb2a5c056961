"""Writers: atomic documents, keyed stores, upserts, appended lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def filesystem_of(uri: str):
    """Filesystem and path of a URI as Spark names it (local paths, ``file:``, ``s3a:``, ``gs:``, ``hdfs:``)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def open_target(uri: str):
    """Filesystem and path of a target below a shared folder, its parent created."""
    filesystem, path = filesystem_of(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return filesystem, path


def write_documents(docs: DataFrame) -> DataFrame:
    """Write ``text`` to ``path`` per row, temporary name first, then rename; a retry writes the same bytes.

    Runs once and returns a small table of what was written.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for target, text in zip(batch["path"], batch["text"]):
                filesystem, path = open_target(target)
                temporary = f"{path}.{uuid.uuid4().hex}.tmp"
                payload = text.encode("utf-8")
                with filesystem.open_output_stream(temporary) as out:
                    out.write(payload)
                filesystem.move(temporary, path)
                sizes.append(len(payload))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    from ..session import materialise

    return materialise(docs.select("path", "text").mapInPandas(write, "path string, bytes long"), "written")


def write_keyed_store(df: DataFrame, path: str, key: str = "key", mode: str = "append") -> None:
    """Keyed store partitioned by the first five characters of the key.

    Rows are brought together by prefix first, hot prefixes split again, so that files stay few and even.
    """
    placed = df.withColumn("prefix", F.substring(key, 1, 5)).hint("rebalance", "prefix")
    placed.write.mode(mode).partitionBy("prefix").parquet(path)


def write_sorted_index(df: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Index in key order, range-partitioned; returns the written table."""
    df.orderBy(key).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last write wins per key; combines on the map side, so a hot key is one line per task."""
    return existing.unionByName(new).groupBy(key).agg(F.max_by(value, order).alias(value))


def split_new(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows marked ``new`` or ``existing`` by key."""
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    return (
        incoming.join(known, key, "left")
        .withColumn("outcome", F.when(F.col("__known"), "existing").otherwise("new"))
        .drop("__known")
    )


def append_lines(df: DataFrame, path: str, line: str, order: str) -> None:
    """Append text lines in order; Spark ends every line, so no final newline can be missing."""
    df.orderBy(order).select(line).write.mode("append").text(path)


def stats_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON lines, columns in name order."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("line"))


def append_json_lines(df: DataFrame, path: str) -> None:
    stats_lines(df).write.mode("append").text(path)


def write_by_class(df: DataFrame, path: str, label: str, index: Column) -> DataFrame:
    """Class-partitioned outputs with names ``class_NNNN/NNNNN``; returns the written table."""
    named = df.withColumn("class", F.format_string("class_%04d", F.col(label))).withColumn(
        "name", F.format_string("%05d", index)
    )
    named.hint("rebalance", "class").write.partitionBy("class").parquet(path)
    return df.sparkSession.read.schema(named.schema).parquet(path)


def run_manifest(outputs: DataFrame, label: str) -> DataFrame:
    return outputs.agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct(label).alias("classes"), F.min(label).alias("first_class"),
        F.max(label).alias("last_class"),
    )


def write_archive(df: DataFrame, path: str, files: int) -> DataFrame:
    """Sample arrays packed into ``files`` parquet files."""
    df.repartition(files).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a table written by an earlier job, or build and write it; one whose files are broken is built anew beside it."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from ..session import exists

    for place in (path, f"{path}-rebuilt"):
        if not exists(spark, place):
            build().write.parquet(place)
        try:
            return spark.read.parquet(place)
        except (PySparkException, Py4JJavaError):
            if place != path:
                raise
    raise AssertionError("unreachable")
