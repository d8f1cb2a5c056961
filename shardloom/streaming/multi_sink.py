"""One stream into several tables that stay in step: every batch reaches all of them, or none that a reader sees."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import exists
from .incremental import guard_config, guard_sources

_COMMIT = "run string, batch long, sink string, rows long"


class Sink(NamedTuple):
    """A table of a stream: its name, how its rows come out of a batch, and what a repeated key means.

    Without ``keys`` rows are appended.  With ``keys``, ``keep`` says which row of a key counts by ``order``: the
    ``first`` (an image that is there stays) or the ``last`` (a label is replaced).
    """

    name: str
    rows: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    keep: str = "last"

    def reduced(self, rows: DataFrame, *later: str) -> DataFrame:
        """The row of each key that counts; combines on the map side.  Columns of ``later`` break ties of the order."""
        if not self.keys:
            return rows
        pick = {"first": F.min_by, "last": F.max_by}[self.keep]
        others = [c for c in rows.columns if c not in self.keys]
        found = rows.groupBy(*self.keys).agg(pick(F.struct(*others), F.struct(*self.order, *later)).alias("r"))
        return found.select(*self.keys, "r.*").select(*rows.columns)


def _run_id(spark: SparkSession, state: str) -> str:
    """Name of the checkpoint, given at its first start."""
    path = f"{state}/run"
    if not exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").write.mode("overwrite").text(path)
    return spark.read.text(path).first()["value"]


def _commits(spark: SparkSession, out: str) -> DataFrame:
    path = f"{out}/commits"
    return spark.read.schema(_COMMIT).parquet(path) if exists(spark, path) else spark.createDataFrame([], _COMMIT)


def convert(
    stream: DataFrame,
    out: str,
    state: str,
    config: dict,
    sinks: list[Sink],
    source: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Run everything that is new into all sinks and return their tables.

    A batch writes a folder per sink and then one commit line per sink in one file; the batch number is the
    transaction.  A batch that broke off between two sinks is written anew over itself; one whose commit stands
    is not written again, even if the stream's own progress was lost with the driver.  Readers go by the
    commits, so they never see a batch in one table and not in the others.  Changed settings, changed inputs
    (with ``source``: table, pattern) and an output that another checkpoint has written are refused.
    """
    spark = stream.sparkSession
    if len({s.name for s in sinks} - {"commits"}) != len(sinks):
        raise ValueError("Sinks need names of their own")
    guard_config(spark, state, {**config, "sinks": [[s.name, *s.keys, s.keep if s.keys else "all"] for s in sinks]})
    if source:
        guard_sources(spark, state, *source)
    run = _run_id(spark, state)
    foreign = _commits(spark, out).where(F.col("run") != run).head()
    if foreign:
        raise ValueError(f"{out} was written by another checkpoint: resume refused")
    schemas: dict[str, StructType] = {s.name: s.rows(stream).schema for s in sinks}

    def write(batch: DataFrame, number: int) -> None:
        if not _commits(batch.sparkSession, out).where(F.col("batch") == number).isEmpty():
            return
        batch.persist()
        try:
            lines = []
            for sink in sinks:
                path = f"{out}/{sink.name}/batch={number}"
                sink.reduced(sink.rows(batch)).write.mode("overwrite").parquet(path)
                rows = batch.sparkSession.read.schema(schemas[sink.name]).parquet(path).count()
                lines.append((run, number, sink.name, rows))
            batch.sparkSession.createDataFrame(lines, _COMMIT).coalesce(1).write.mode("append").parquet(f"{out}/commits")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return {s.name: read(spark, out, s, schemas[s.name]) for s in sinks}


def read(spark: SparkSession, out: str, sink: Sink, schema: StructType) -> DataFrame:
    """The table of a sink over all committed batches; batches without a commit are not opened."""
    path = f"{out}/{sink.name}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    done = _commits(spark, out).where((F.col("sink") == sink.name) & (F.col("rows") > 0)).select("batch").distinct()
    written = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    # One line per batch: adaptive execution broadcasts it and prunes the folders by it.
    rows = written.join(done, "batch", "left_semi")
    return sink.reduced(rows, "batch").select(*schema.fieldNames())
