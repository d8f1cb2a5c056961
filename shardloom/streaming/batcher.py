"""Stateful same-bucket batcher: a buffer per (rank, bucket) that gives out full batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "rank long, bucket string, batch_no long, first_index long, last_index long, members string, full boolean"


class BucketBatcher(StatefulProcessor):
    """State per key: fewer than ``size`` waiting indices and the next batch number.

    A key is one bucket of one worker, and a worker owns an index range of bounded
    size, so a hot bucket is spread over the workers.
    """

    def __init__(self, size: int, flush_after_ms: int | None = None):
        self.size = size
        self.flush_after_ms = flush_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "idx long")
        self.next_no = handle.getValueState("next_no", "n long")

    def _emit(self, key, number: int, batch: list[int], full: bool) -> dict:
        return {
            "rank": key[0], "bucket": key[1], "batch_no": number, "first_index": batch[0], "last_index": batch[-1],
            "members": ",".join(map(str, batch)), "full": full,
        }

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        number = self.next_no.get()[0] if self.next_no.exists() else 0
        # Index order inside a micro-batch, whatever order the tasks delivered; only indices are held.
        arrived = np.sort(np.concatenate([frame["idx"].to_numpy(dtype="int64") for frame in rows]))
        for at in range(0, len(arrived), 1 << 16):
            out = []
            for value in arrived[at : at + (1 << 16)].tolist():
                buffer.append(value)
                if len(buffer) == self.size:
                    out.append(self._emit(key, number, buffer, True))
                    number, buffer = number + 1, []
            if out:
                yield pd.DataFrame(out)
        self.next_no.update((number,))
        if buffer:
            self.waiting.put([(v,) for v in buffer])
            if self.flush_after_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after_ms)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            buffer = [r[0] for r in self.waiting.get()]
            number = self.next_no.get()[0] if self.next_no.exists() else 0
            self.waiting.clear()
            self.next_no.update((number + 1,))
            yield pd.DataFrame([self._emit(key, number, buffer, False)])

    def close(self) -> None:
        pass


def batch_stream(stream: DataFrame, size: int, flush_after_ms: int | None = None) -> DataFrame:
    """Batches of ``rank, bucket, idx`` rows in arrival order; the rest waits or is flushed by a timer."""
    return stream.groupBy("rank", "bucket").transformWithStateInPandas(
        statefulProcessor=BucketBatcher(size, flush_after_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if flush_after_ms is None else "ProcessingTime",
    )


def waiting_rows(batches: DataFrame, state: str) -> DataFrame:
    """The rest of every key as its last, shorter batch, read from the state of a run that has ended."""
    spark = batches.sparkSession
    store = spark.read.format("statestore")
    kept = store.option("stateVarName", "waiting").load(f"{state}/checkpoint")
    numbers = store.option("stateVarName", "next_no").load(f"{state}/checkpoint")
    rest = kept.select(F.col("key"), F.explode("list_value").alias("v")) if "list_value" in kept.columns else kept.select(
        "key", F.col("list_element").alias("v")
    )
    rest = rest.groupBy("key").agg(F.sort_array(F.collect_list("v.idx")).alias("rest"))  # fewer than a batch
    return rest.join(numbers.select("key", F.col("value.n").alias("n")), "key").select(
        F.col("key.rank").alias("rank"), F.col("key.bucket").alias("bucket"), F.col("n").alias("batch_no"),
        F.get("rest", F.lit(0)).alias("first_index"), F.element_at("rest", -1).alias("last_index"),
        F.array_join(F.col("rest").cast("array<string>"), ",").alias("members"), F.lit(False).alias("full"),
    )


def run(batches: DataFrame, out: str, state: str, with_rest: bool = True) -> DataFrame:
    """Run the batcher over what is there and return the batches written and, unless more is to come, the rest."""
    spark = batches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        batches.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    written = spark.read.schema(batches.schema).parquet(out)
    return written.unionByName(waiting_rows(batches, state)) if with_rest else written
