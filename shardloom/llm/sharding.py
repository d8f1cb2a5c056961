"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, minimal movement on growth.

A row's shard depends on its key and the shard count alone.  With one shard more, a row either stays or
moves into the new shard.  Nothing is shuffled to find a shard; only the gapless slots need an exchange,
and that one moves narrow rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

_STEP = np.uint64(2862933555777941757)  # the multiplier of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys in lockstep; a key leaves the loop when its next jump passes the end."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    while len(active):
        key[active] = key[active] * _STEP + np.uint64(1)
        draw = (key[active] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = np.floor((shard[active] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = jump < shards
        active = active[inside]
        shard[active] = jump[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Column form of :func:`jump_hash`; a null key takes the shard of key 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: int = 40, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (one shard more) and ``slot`` (gapless from 0 in each shard).

    Slots come in two steps so that no task holds a shard: rows are ranked inside chunks of a shard (chunks
    split by a hash of key and ``ties``), then each chunk is moved up by the sizes of the chunks before it.
    ``rows`` should be narrow; join wider columns afterwards.

    Null keys go to the shard of key 0.  Repeated rows get slots of their own.  Empty input gives no rows.
    Columns named like a result are replaced.
    """
    spark = rows.sparkSession
    chunks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.drop("shard", "grown_shard", "slot")
    placed = rows.select(
        "*",
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(key, *ties), F.lit(chunks)).cast("int").alias("__chunk"),
    )
    sizes = placed.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    # shards x chunks lines at most, one window per shard
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = placed.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("shard", "__chunk").orderBy(F.col(key), *map(F.col, ties)))
    )
    return ranked.join(offsets, ["shard", "__chunk"]).select(
        *rows.columns, "shard", "grown_shard", (F.col("__before") + F.col("__rank") - 1).alias("slot")
    )
