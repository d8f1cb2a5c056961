"""Joins of samples with labels, sidecars, scores, outputs and each other.

No join carries a broadcast hint: adaptive execution measures the small side
and falls back to a shuffle join with skew splitting when it is not small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import uniform
from .index import expand_counts


def overlay_captions(samples: DataFrame, captions: DataFrame, keys: list[str], fields: str = "fields") -> DataFrame:
    """Merge sidecar captions into the ``fields`` map of each sample, later suffixes winning.

    ``captions`` is long: ``keys, suffix_ordinal, caption_type, text``.  The last
    text per type is found before any array is built, so an array holds one
    entry per caption type.
    """
    last = captions.groupBy(*keys, "caption_type").agg(F.max_by("text", "suffix_ordinal").alias("text"))
    merged = last.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("caption_type", "text")))).alias("__over")
    )
    kept = F.map_filter(F.col(fields), lambda k, _: ~F.coalesce(F.map_contains_key(F.col("__over"), k), F.lit(False)))
    return (
        samples.join(merged, keys, "left")
        .withColumn(fields, F.when(F.col("__over").isNull(), F.col(fields)).otherwise(F.map_concat(kept, F.col("__over"))))
        .drop("__over")
    )


def scores_of_present_types(samples: DataFrame, scores: DataFrame, keys: list[str], fields: str = "fields"):
    """Scores whose caption type exists in the sample."""
    present = samples.select(*keys, F.explode(F.map_keys(fields)).alias("caption_type"))
    return scores.join(present, [*keys, "caption_type"])


def caption_or_default(fields: Column, caption_type: Column, default: str = "prompt") -> Column:
    """The chosen caption; an absent type falls back to the default, a null caption is empty."""
    chosen = F.when(F.map_contains_key(fields, caption_type), F.try_element_at(fields, caption_type)).otherwise(
        F.try_element_at(fields, F.lit(default))
    )
    return F.coalesce(chosen, F.lit(""))


def strict_lookup(keys: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Every key must have a label; the action that reads the result fails on the first that has none."""
    marked = labels.withColumn("__found", F.lit(True))
    missing = F.concat(F.lit("No label for "), F.col(key).cast("string"))
    found = F.coalesce(F.col("__found"), F.raise_error(missing).cast("boolean"))
    return keys.join(marked, key, "left").where(found).drop("__found")


def missing_labels(keys: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return keys.join(labels, key, "left_anti")


def exclude_holdout(samples: DataFrame, excluded: DataFrame, index: str) -> DataFrame:
    return samples.join(excluded.select(index).distinct(), index, "left_anti")


def pair_report(members: DataFrame, shards: DataFrame) -> DataFrame:
    """Per shard: declared and found samples, keys without a pair, keys whose sizes disagree.

    ``members`` is ``shard, key, ext, width, height``; ``shards`` is ``shard, nsamples``.
    """
    per_key = members.groupBy("shard", "key").agg(
        F.count_if(F.col("ext") == "jpg").alias("images"),
        F.count_if(F.col("ext") == "json").alias("records"),
        ((F.min("width") != F.max("width")) | (F.min("height") != F.max("height"))).alias("conflict"),
    )
    found = per_key.groupBy("shard").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if((F.col("images") == 0) | (F.col("records") == 0)).alias("unpaired"),
        F.count_if("conflict").alias("size_conflicts"),
    )
    zero = F.lit(0).cast("bigint")
    return shards.join(found, "shard", "full_outer").select(
        "shard",
        F.coalesce(F.col("nsamples").cast("bigint"), zero).alias("declared"),
        F.coalesce("found", zero).alias("found"),
        F.coalesce("unpaired", zero).alias("unpaired"),
        F.coalesce("size_conflicts", zero).alias("size_conflicts"),
        F.col("nsamples").cast("bigint").eqNullSafe(F.col("found")).alias("count_ok"),
    )


def condition_seeds(conditions: DataFrame, index: str, seeds_each: Column) -> DataFrame:
    """Each condition with each seed number: row number ``i`` is condition ``i div s``, seed ``i mod s``."""
    spread = expand_counts(conditions.withColumn("__s", seeds_each.cast("bigint")), "__s", "seed_no")
    return spread.withColumn("row_no", F.col(index) * F.col("__s") + F.col("seed_no")).drop("__s")


def cyclic_zip(
    tiles: DataFrame, labels: DataFrame, n_tiles: Column, n_labels: Column, pos: str = "pos", whole_rounds: bool = True
) -> DataFrame:
    """Tile ``p`` gets label ``p mod n``; fails when the counts do not divide, unless the last round may be cut short."""
    keyed = tiles.withColumn("label_pos", F.pmod(F.col(pos), n_labels))
    if whole_rounds:
        fits = F.when(n_tiles % n_labels == 0, True).otherwise(
            F.raise_error(F.lit("Tile count is not a multiple of the label count")).cast("boolean")
        )
        keyed = keyed.where(fits)
    return keyed.join(labels.withColumnRenamed(pos, "label_pos"), "label_pos")


def pending(work: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """Work whose output name does not exist yet."""
    return work.join(existing.select(name), name, "left_anti")


def order_audit(cache: DataFrame, real: DataFrame, index: str, share: float, seed) -> DataFrame:
    """Cached against real key for the first index and a hash sample; ``share=1`` checks everything."""
    picked = cache.where((F.col(index) == 0) | (uniform(seed, F.col(index)) < share))
    joined = picked.join(real.withColumnRenamed("key", "real_key"), index, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.col("key").eqNullSafe(F.col("real_key"))).alias("mismatches"),
    )
