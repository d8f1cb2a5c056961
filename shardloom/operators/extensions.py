"""Aggregates and SQL functions for users of the library, made of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ..functions.vectors import norm
from .metrics import weighted_mean

__all__ = ["cosine_centroid", "ema_at", "register_prompt_flags", "weighted_mean"]


def ema_at(value: Column, position: Column, size: Column, decay: float) -> Column:
    """Final moving average of a series whose rows know their position and the length of the series."""
    faded = F.pow(F.lit(decay), size - 1 - position)
    return F.sum(value * F.when(position == 0, faded).otherwise(faded * (1 - decay)))


def cosine_centroid(vec: Column, dims: int) -> Column:
    """Mean of the unit vectors of a group, one partial average per dimension."""
    length = norm(vec)
    return F.array(*[F.avg(vec[i].cast("double") / length) for i in range(dims)])


def register_prompt_flags(spark: SparkSession, table: list[tuple[str, int, int]], name: str = "prompt_flags") -> None:
    """SQL function ``prompt_flags(prompt)``: clean text, ratio, nearest bucket and output size as a struct."""
    entries = ", ".join(
        f"struct(abs({r}D - ar) AS d, {i} AS o, '{r}' AS ratio, {h} AS h, {w} AS w)" for i, (r, h, w) in enumerate(table)
    )

    def pair(flag: str) -> str:
        return rf"split(regexp_extract(prompt, '--{flag}\\s+(\\d+:\\d+)', 1), ':')"

    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_ratio(prompt STRING) RETURNS DOUBLE RETURN
        coalesce(try_cast({pair('aspect_ratio')}[0] AS DOUBLE) / try_cast(get({pair('aspect_ratio')}, 1) AS DOUBLE),
                 try_cast({pair('ar')}[0] AS DOUBLE) / try_cast(get({pair('ar')}, 1) AS DOUBLE), 1.0D)"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_bucket(ar DOUBLE)
        RETURNS STRUCT<d: DOUBLE, o: INT, ratio: STRING, h: INT, w: INT> RETURN array_min(array({entries}))"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(prompt STRING)
        RETURNS STRUCT<clean: STRING, ar: DOUBLE, ratio: STRING, bucket_h: INT, bucket_w: INT, out_h: DOUBLE, out_w: DOUBLE>
        RETURN struct(
            substring_index(substring_index(substring_index(prompt, '--aspect_ratio', 1), '--ar', 1), '--hw', 1),
            {name}_ratio(prompt),
            {name}_bucket({name}_ratio(prompt)).ratio,
            {name}_bucket({name}_ratio(prompt)).h,
            {name}_bucket({name}_ratio(prompt)).w,
            coalesce(try_cast({pair('hw')}[0] AS DOUBLE), CAST({name}_bucket({name}_ratio(prompt)).h AS DOUBLE)),
            coalesce(try_cast(get({pair('hw')}, 1) AS DOUBLE), CAST({name}_bucket({name}_ratio(prompt)).w AS DOUBLE)))"""
    )
