"""Evaluate an expensive expression once, where Catalyst would repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def with_value_where(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Add a column and keep the rows whose value passes, computing the value once.

    A plain filter on a computed column is pushed below it and computes it again
    for every use, which is what costs on whole texts.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), lambda v: keep(v))))
