"""Set operations on keys, listings and index intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .index import shard_ranges


def append_all(*parts: DataFrame) -> DataFrame:
    """Lists one after the other, duplicates kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def key_relation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the side it is on: ``left``, ``right`` or ``both``."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right")
    return sides.select(key, side.alias("side"))


def lengths_to_ranges(shards: DataFrame, order: str, length: str) -> DataFrame:
    return shard_ranges(shards, order, length)


def intersect_range(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """Each half-open range cut to ``[low, high)``, empty results dropped."""
    cut = ranges.withColumn("start", F.greatest("start", F.lit(low).cast("bigint"))).withColumn(
        "stop", F.least("stop", F.lit(high).cast("bigint"))
    )
    return cut.where("start < stop")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines whose multiplicity differs, with both counts; empty means equal listings.

    One aggregation over the union: combined on the map side, no join.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = both.groupBy(*columns).agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"))
    return counts.where("left_n <> right_n")


def refuse_existing(new_lines: DataFrame, existing: DataFrame, line: str, strict: bool = True) -> DataFrame:
    """New lines when none exists yet; strict mode fails on the first duplicate, else duplicates are left out."""
    if not strict:
        return new_lines.join(existing.select(line), line, "left_anti")
    known = existing.select(line).distinct().withColumn("__known", F.lit(True))
    fresh = F.when(
        F.col("__known"), F.raise_error(F.concat(F.lit("Line already present: "), F.col(line))).cast("boolean")
    ).otherwise(True)
    return new_lines.join(known, line, "left").where(fresh).drop("__known")
