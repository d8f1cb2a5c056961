"""Shapes of executed plans: no shuffle of big sides, no files read in vain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardloom.operators import index as ix


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("big") / "table")
    spark.range(40_000).select(F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("payload")).repartition(
        6
    ).write.parquet(path)
    return path


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df, capsys) -> str:
    df.collect()
    capsys.readouterr()
    df.explain("simple")
    return capsys.readouterr().out


def test_global_index_does_not_shuffle_rows(spark, big, small_broadcasts, capsys):
    plan = plan_of(ix.with_global_index(spark, big), capsys)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_renumbering_does_not_shuffle_rows(spark, big, small_broadcasts, capsys):
    excluded = spark.createDataFrame([(5,), (77,), (39_999,)], "i bigint")
    renumbered = ix.dense_renumber(spark.read.parquet(big), "i", excluded, 40_000)
    plan = plan_of(renumbered, capsys)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.new_index for r in renumbered.collect()) == list(range(39_997))


def test_prefix_reads_only_the_files_it_needs(spark, big):
    first = ix.first_rows(spark, big, 0.2, ["i"])
    assert len(first.inputFiles()) < len(spark.read.parquet(big).inputFiles())
    assert sorted(r.global_index for r in first.collect()) == list(range(8_000))
    assert ix.first_rows(spark, big, 0.0, ["i"]).count() == 0
