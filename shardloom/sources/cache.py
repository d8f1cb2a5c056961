"""A cached table that notices changed sources and rebuilds the lines of those alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import exists
from .files import changed_files

#: Changed sources that are built and switched to in one step; a build that breaks off loses one step.
STEP_FILES = 10_000
_VERSION = "version long, path string, stamp string, generation long"


def stamped(listing: DataFrame, *facts: str) -> DataFrame:
    """(path, stamp) of a file listing; two stamps are equal if all ``facts`` are."""
    return listing.select("path", F.to_json(F.struct(*(facts or ("size_bytes", "mtime")))).alias("stamp"))


def _current(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Lines of the newest version and its number, -1 before the first."""
    if not exists(spark, f"{path}/versions"):
        return spark.createDataFrame([], _VERSION), -1
    lines = spark.read.schema(_VERSION).parquet(f"{path}/versions")
    newest = lines.agg(F.max("version")).first()[0]
    if newest is None:
        return spark.createDataFrame([], _VERSION), -1
    return lines.where(F.col("version") == newest), newest


def refresh(
    spark: SparkSession,
    path: str,
    listing: DataFrame,
    build: Callable[[list[str]], DataFrame],
    source: str = "source",
    step_files: int = STEP_FILES,
) -> list[str]:
    """Bring the cache at ``path`` up to ``listing`` (path, stamp) and return the sources that were read.

    ``build`` gets the paths of sources and gives their lines with the path in the column ``source``.  New and
    changed sources are built into a generation of their own; a version is one small file that says which
    generation holds the lines of which source, and writing it is the switch.  Readers of an older version are not
    disturbed, a build that broke off is redone from its last switch, and the lines of sources that changed or
    are gone are not read any more.
    """
    known, version = _current(spark, path)
    moved = changed_files(known, listing, "path", ("stamp",))
    fresh = [r["path"] for r in moved.where("after IS NOT NULL").select("path").orderBy("path").collect()]
    gone = not moved.where("after IS NULL").isEmpty()
    if version < 0 and not fresh:
        raise FileNotFoundError(f"No sources for the cache {path}")
    steps = [fresh[i : i + step_files] for i in range(0, len(fresh), step_files)] or ([[]] if gone else [])
    for step in steps:
        known, version = _current(spark, path)
        number = version + 1
        built = spark.createDataFrame([(p,) for p in step], "path string")
        if step:
            build(step).write.mode("overwrite").parquet(f"{path}/rows/generation={number}")
        kept = known.join(listing, ["path", "stamp"], "left_semi").select("path", "stamp", "generation")
        added = listing.join(built, "path", "left_semi").select("path", "stamp", F.lit(number).cast("long").alias("generation"))
        lines = kept.unionByName(added).select(F.lit(number).cast("long").alias("version"), "path", "stamp", "generation")
        # A cache that has lost its last source has a version too: one without lines.
        if lines.isEmpty():
            lines = spark.createDataFrame([(number, None, None, None)], _VERSION)
        lines.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return fresh


def read(spark: SparkSession, path: str, source: str = "source") -> DataFrame:
    """The lines of the newest version of a cache."""
    current, version = _current(spark, path)
    if version < 0:
        raise FileNotFoundError(f"No cache at {path}")
    held = current.where("path IS NOT NULL").select(F.col("path").alias(source), "generation")
    # The list of sources is small; generations that hold nothing any more are not opened.
    live = [r["generation"] for r in held.select("generation").distinct().collect()]
    rows = spark.read.option("basePath", f"{path}/rows")
    if not live:
        return rows.parquet(f"{path}/rows").where(F.lit(False)).drop("generation")
    lines = rows.parquet(*[f"{path}/rows/generation={g}" for g in sorted(live)])
    columns = [c for c in lines.columns if c != "generation"]
    lines = lines.withColumn("generation", F.col("generation").cast("long"))
    return lines.join(held, [source, "generation"], "left_semi").select(*columns)


def cached(
    spark: SparkSession, path: str, listing: DataFrame, build: Callable[[list[str]], DataFrame], source: str = "source"
) -> DataFrame:
    """:func:`refresh`, then :func:`read`."""
    refresh(spark, path, listing, build, source)
    return read(spark, path, source)
