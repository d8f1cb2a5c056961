"""Which recovery files are old, and which one is the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import RECOVERY_NAME


def recovery_ids(files: DataFrame, name: str = "name", link: str = "is_link") -> DataFrame:
    return (
        files.where(F.regexp_like(F.col(name), F.lit(RECOVERY_NAME)) & ~F.col(link))
        .withColumn("epoch", F.regexp_extract(name, RECOVERY_NAME, 1).cast("bigint"))
        .withColumn("step", F.regexp_extract(name, RECOVERY_NAME, 2).cast("bigint"))
    )


def prunable(files: DataFrame, keep_last: int, name: str = "name", link: str = "is_link") -> DataFrame:
    """Recovery files outside the newest ``keep_last`` ids; deleting them is the caller's business."""
    if keep_last < 1:
        raise ValueError("keep_last must be at least one")
    found = recovery_ids(files, name, link)
    ids = found.select("step", "epoch").distinct()
    newest = ids.orderBy(F.desc("step"), F.desc("epoch")).limit(keep_last)
    return found.join(newest, ["step", "epoch"], "left_anti").select(name, "step", "epoch")


def latest(files: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """The file with the highest step in its name, else the newest by time."""
    step = F.regexp_extract(F.col(path), r"epoch=\d+-step=(\d+)[^/]*$", 1).try_cast("bigint")
    rank = F.struct(step.isNotNull().alias("named"), F.coalesce(step, F.lit(-1)).alias("step"),
                    F.when(step.isNull(), F.col(mtime)).alias("mtime"), F.col(path).alias("path"))
    return files.agg(F.max_by(path, rank).alias("path"), F.max(step).alias("step"))
