"""Faults of the fourth round of findings, each on the smallest input that shows it."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter, functions as F
from pyspark.sql.types import StructType

from shardloom.plans import convert as conversion
from shardloom.sources import files, tar
from shardloom.sources.tar_sink import TarShardWriter

from .test_convert import SCHEMA, jpeg
from .test_findings_r03 import _exchanged_bytes


def write_input(spark, folder, name, n, block_bytes=None, words=40):
    """One parquet file of images with captions that do not compress; row groups of about ``block_bytes``."""
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        text = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(words))
        rows.append(((jpeg(10, 5), f"p{i}"), f"{i} {text}", [(None, text, True, None)], 10, 5, f"img{i}"))
    out = spark.createDataFrame(rows, SCHEMA).coalesce(1).write
    if block_bytes:
        out = out.option("parquet.block.size", block_bytes)  # looked at after 100 rows
    staged, path = folder / "staged" / name, folder / "in" / f"{name}.parquet"
    out.parquet(str(staged))
    path.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy(next(staged.glob("part-*.parquet")), path)
    return rows


def written(spark, output):
    """(shard, name, caption) of the records in the order in which they stand."""
    members = tar.read_members(spark, f"{output}/shards", extensions="json")
    prompt = F.get_json_object(F.decode("content", "UTF-8"), "$.original_caption")
    found = members.select(F.regexp_extract("shard", r"([^/]*)$", 1).alias("shard"), "member_ordinal", "name", prompt.alias("caption"))
    return [(r.shard, r.name, r.caption) for r in found.orderBy("shard", "member_ordinal").collect()]


def wanted(stem, rows, size):
    return [(f"{stem}-{i // size:05d}.tar", f"{stem}-{i:09d}.json", r[1]) for i, r in enumerate(rows)]


def convert(spark, folder, size):
    ledger = conversion.convert(spark, f"{folder}/in", f"{folder}/out", shard_size=size).collect()
    assert {r.status for r in ledger} == {"complete"}
    assert conversion.verify(spark, f"{folder}/out").collect() == []


def row_groups(spark, folder):
    return {r["name"]: r.row_groups for r in files.inventory(spark, f"{folder}/in").collect()}


def test_records_are_written_where_their_rows_are_read(spark, tmp_path, monkeypatch):
    given = {x: write_input(spark, tmp_path, x, n) for x, n in (("a", 300), ("b", 125))}
    save, moved = DataFrameWriter.save, []

    def watched(writer, *args, **kwargs):
        writer._df.collect()
        moved.append(_exchanged_bytes(writer._df))
        return save(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", watched)
    convert(spark, tmp_path, 50)
    assert moved == [0]
    assert written(spark, tmp_path / "out") == wanted("a", given["a"], 50) + wanted("b", given["b"], 50)


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_shards_that_row_groups_cut_are_whole_and_in_order(spark, tmp_path, size):
    rows = write_input(spark, tmp_path, "a", 450, 20_000)
    groups = row_groups(spark, tmp_path)["a.parquet"]
    assert len(groups) > 3 and sum(groups) == 450
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")  # a task for each row group
    try:
        convert(spark, tmp_path, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert written(spark, tmp_path / "out") == wanted("a", rows, size)
    ends = {sum(groups[:k]) for k in range(1, len(groups))}
    listed = conversion.cut_shards(spark, [f"{tmp_path}/in/a.parquet"], size).collect()
    assert [(r.stem, r.shards, sorted(r.cut)) for r in listed] == [("a", -(-450 // size), sorted({e // size for e in ends if e % size}))]


def test_too_many_cut_shards_for_a_broadcast_move_all_rows(spark, tmp_path, monkeypatch):
    rows = write_input(spark, tmp_path, "a", 450, 20_000)
    monkeypatch.setattr(conversion, "MAX_BROADCAST_LINES", 1)
    convert(spark, tmp_path, 7)
    assert written(spark, tmp_path / "out") == wanted("a", rows, 7)


def test_inputs_of_one_name_still_share_their_shards(spark, tmp_path):
    rows = write_input(spark, tmp_path, "x/a", 30)
    (tmp_path / "in" / "y").mkdir()
    shutil.copy(tmp_path / "in" / "x" / "a.parquet", tmp_path / "in" / "y" / "a.parquet")
    conversion.convert(spark, f"{tmp_path}/in", f"{tmp_path}/out", shard_size=20)
    assert written(spark, tmp_path / "out") == sorted(2 * wanted("a", rows, 20))


def test_a_shard_that_is_not_together_stops_the_job(spark, tmp_path):
    rows = spark.range(20).select("id", F.format_string("k%02d", "id").alias("key"), F.encode("key", "UTF-8").alias("v"))
    with pytest.raises(PySparkException, match="came to several tasks"):
        tar.write_shards(rows.repartition(2), f"{tmp_path}/out", "id", {"txt": "v"}, shard_size=20, together=True)
    assert not list((tmp_path / "out").glob("*.tar"))


def test_a_task_that_starts_after_the_abort_leaves_nothing(tmp_path):
    schema = StructType().add("shard", "string").add("key", "string").add("jpg", "binary")
    writer = TarShardWriter(schema, {"path": f"{tmp_path}/out"}, False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([]))
    assert list((tmp_path / "out").iterdir()) == []
