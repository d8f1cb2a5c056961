"""The tar shard source and sink: all or nothing on writing, nothing but the asked on reading."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom.sources import tar, tar_sink

ROOT = Path(__file__).resolve().parent.parent


def samples(spark, n=40, per=10, broken=None):
    rows = [(f"s-{i // per:05d}.tar", f"k{i:04d}", None if i == broken else bytes([i]) * (100 + 700 * (i % 3)), b"{}") for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, key string, jpg binary, json binary")
    return df.repartition(3, "shard").sortWithinPartitions("shard", "key")


def save(df, folder, mode="append", **options):
    tar.register(df.sparkSession)
    df.write.format("tarshards").mode(mode).options(**options).save(str(folder))


def names(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_sink_and_source_round_trip(spark, tmp_path):
    save(samples(spark), tmp_path / "out", report=str(tmp_path / "report"))
    assert names(tmp_path / "out") == [f"s-{i:05d}.tar" for i in range(4)]
    report = [json.loads(x) for f in (tmp_path / "report").glob("*.json") for x in f.read_text().splitlines()]
    assert [(r["shard"], r["nsamples"]) for r in report] == [(f"s-{i:05d}.tar", 10) for i in range(4)]
    assert all((tmp_path / "out" / r["shard"]).stat().st_size == r["size_bytes"] for r in report)
    found = tar.read_members(spark, str(tmp_path / "out")).collect()
    assert len(found) == 80 and all(bytes(m.content) == bytes([int(m.name[1:5])]) * m.size for m in found if m.name.endswith("jpg"))
    save(samples(spark, n=0), tmp_path / "none")
    assert tar.read_members(spark, str(tmp_path / "out")).count() == 80


def test_a_failed_job_leaves_no_shard(spark, tmp_path):
    with pytest.raises(PySparkException, match="k0037.jpg has no payload"):
        save(samples(spark, broken=37), tmp_path / "out")
    assert names(tmp_path / "out") == []
    save(samples(spark, broken=37), tmp_path / "out", may_lack="jpg")
    assert len(names(tmp_path / "out")) == 4


def test_names_that_exist_or_come_twice_stop_the_job(spark, tmp_path):
    out = tmp_path / "out"
    save(samples(spark, n=10), out)
    with pytest.raises(PySparkException, match="s-00000.tar exists"):
        save(samples(spark, n=20), out)
    assert names(out) == ["s-00000.tar"]
    with pytest.raises(PySparkException, match="came to several tasks"):
        save(samples(spark, n=20, per=20).repartition(2), tmp_path / "two")
    assert names(tmp_path / "two") == []
    mixed = samples(spark, n=20).coalesce(1).sortWithinPartitions(F.col("key").substr(5, 1), "shard")
    with pytest.raises(PySparkException, match="do not come together"):
        save(mixed, tmp_path / "mixed")
    assert names(tmp_path / "mixed") == []
    with pytest.raises(PySparkException, match="not binary"):
        save(samples(spark).withColumn("cls", F.lit("text")), out)


def test_overwrite_removes_what_it_has_not_written(spark, tmp_path):
    out = tmp_path / "out"
    save(samples(spark, n=40), out)
    save(samples(spark, n=20), out, mode="overwrite")
    assert names(out) == ["s-00000.tar", "s-00001.tar"]
    assert tar.read_members(spark, str(out)).count() == 40


def test_a_commit_that_broke_off_is_invisible_and_then_finished(spark, tmp_path):
    out = tmp_path / "out"
    save(samples(spark, n=10), out)
    staged = out / "_staging-x" / "a"
    staged.mkdir(parents=True)
    for i, name in enumerate(["s-00007.tar", "s-00008.tar"]):
        (staged / f"{i}.tar").write_bytes((out / "s-00000.tar").read_bytes())
    journal = {"moves": [[f"{staged}/{i}.tar", f"{out}/s-0000{7 + i}.tar"] for i in range(2)], "deletes": [], "staging": str(out / "_staging-x")}
    (out / "_commit-x.json").write_text(json.dumps(journal))
    (staged / "0.tar").rename(out / "s-00007.tar")  # the driver died after the first move
    assert {Path(r.shard).name for r in tar.read_members(spark, str(out)).select("shard").distinct().collect()} == {"s-00000.tar"}
    save(samples(spark, n=20, per=10).where("shard = 's-00001.tar'"), out)
    assert names(out) == ["s-00000.tar", "s-00001.tar", "s-00007.tar", "s-00008.tar"]
    assert tar.read_members(spark, str(out)).count() == 80
    tar_sink.finish_commits(str(out))


KILLED = """
    import os, signal, sys, time
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession, functions as F
    from shardloom.sources import tar
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    marker = {marker!r}

    def kill_once(batches):
        for i, batch in enumerate(batches):
            if i == 3 and "k0000" in batch.column("shard_key").to_pylist()[0] or i == 3 and not os.path.exists(marker):
                if not os.path.exists(marker):
                    open(marker, "w").close()
                    time.sleep(1)
                    os.kill(os.getpid(), signal.SIGKILL)
            yield batch.drop_columns(["shard_key"])

    rows = spark.range(200).select(F.format_string("s-%05d.tar", F.expr("id div 50")).alias("shard"), F.format_string("k%04d", "id").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("txt"))
    arranged = rows.repartition("shard").sortWithinPartitions("shard", "key").withColumn("shard_key", F.col("key"))
    tar.register(spark)
    arranged.mapInArrow(kill_once, "shard string, key string, txt binary").write.format("tarshards").mode("append").save({out!r})
    assert os.path.exists(marker)
    print("READ", tar.read_members(spark, {out!r}).agg(F.count("name"), F.count_distinct("name")).first())
"""


def test_a_killed_task_is_retried_without_a_second_shard(tmp_path):
    out, marker = str(tmp_path / "out"), str(tmp_path / "killed")
    script = textwrap.dedent(KILLED).format(root=str(ROOT), marker=marker, out=out)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run(["timeout", "150", sys.executable, "-c", script], capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "count(name)=200" in done.stdout and "200)" in done.stdout
    assert names(out) == [f"s-{i:05d}.tar" for i in range(4)]


# ---------------------------------------------------------------- reading by index


@pytest.fixture
def archive(spark, tmp_path):
    """One archive of forty members, its index, and a block table of small blocks."""
    out = tmp_path / "one"
    save(samples(spark, n=20, per=20), out)
    index = tar.member_index(spark, str(out), str(tmp_path / "index"))
    return out, index, tar.member_blocks(index, str(tmp_path / "blocks"), 4096)


def spoil(path, keep):
    """Overwrite every byte of an archive outside the ranges to keep."""
    data = bytearray(path.read_bytes())
    kept = bytearray(b"\xff" * len(data))
    for lo, hi in keep:
        kept[lo:hi] = data[lo:hi]
    path.write_bytes(bytes(kept))


def test_fetch_reads_nothing_but_the_asked_ranges(spark, archive):
    out, index, _ = archive
    lines = {r.name: r for r in index.collect()}
    asked = ["k0003.jpg", "k0004.json", "k0017.jpg"]
    spoil(out / "s-00000.tar", [(lines[n].offset, lines[n].offset + lines[n].size) for n in asked])
    wanted = spark.createDataFrame([(n,) for n in [*asked, "absent"]], "name string")
    found = {r.name: bytes(r.content) for r in tar.fetch_members(tar.find_members(index, wanted), 4096).collect()}
    assert found == {n: b"{}" if n.endswith("json") else bytes([int(n[1:5])]) * lines[n].size for n in asked}


def test_fetch_takes_repeats_nulls_and_clashing_columns(spark, archive):
    out, index, _ = archive
    rows = index.where("name like '%.jpg'").unionByName(index.limit(3)).withColumn("part", F.lit("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "n", 0, 0, 5, "y")], rows.schema))
    got = tar.fetch_members(rows, 2048)
    assert got.columns == [*rows.columns, "content"]
    assert got.where("content is null").count() == 1 and got.where("octet_length(content) = size").count() == rows.count() - 1
    assert tar.fetch_members(index.limit(0)).count() == 0
    cut = index.withColumn("size", F.lit(10**7).cast("long")).limit(1)
    with pytest.raises(PySparkException, match="ends before"):
        tar.fetch_members(cut).collect()


def test_blocks_cut_an_archive_into_input_partitions(spark, archive):
    out, index, blocks = archive
    whole = tar.read_members(spark, str(out))
    cut = tar.read_members(spark, str(out), blocks=blocks)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 4
    digest = lambda df: sorted((r.member_ordinal, r.name, r.header, r.offset, hashlib.md5(r.content).hexdigest()) for r in df.collect())
    assert digest(whole) == digest(cut) and len(digest(cut)) == 40


def test_filters_leave_blocks_unread(spark, archive):
    out, index, blocks = archive
    cut = lambda: tar.read_members(spark, str(out), blocks=blocks)
    lines = index.orderBy("header").collect()
    last = [r for r in lines if r.name == "k0019.jpg"][0]
    starts = [r.start for r in spark.read.parquet(blocks).collect() if r.start <= last.header]
    spoil(out / "s-00000.tar", [(max(starts), last.offset + 10_240)])  # only the block of the last members is whole
    found = cut().where("name = 'k0019.jpg'")
    assert [r.size for r in found.collect()] == [last.size]
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString() or found.rdd.getNumPartitions() == 1
    assert cut().where(F.col("name").isin("k0019.jpg", "k0019.json")).count() == 2
    assert cut().where("member_ordinal >= 38").count() == 2
    assert cut().where("name >= 'k0019' and name like '%.json'").count() == 1
    assert cut().where("name like 'k0019%' and size > 5").count() == 1
    assert cut().where("shard = 'elsewhere'").count() == 0


def test_shards_are_left_out_by_filter_and_new_ones_read_whole(spark, tmp_path):
    out = tmp_path / "out"
    save(samples(spark, n=20), out)
    blocks = tar.member_blocks(tar.member_index(spark, str(out), str(tmp_path / "index")), str(tmp_path / "blocks"), 4096)
    save(samples(spark, n=30).where("shard = 's-00002.tar'"), out)  # not in the block table
    assert tar.read_members(spark, str(out), blocks=blocks).count() == 60
    spoil(out / "s-00000.tar", [])
    rest = tar.read_members(spark, str(out), blocks=blocks).where(F.col("shard").isin(f"{out}/s-00001.tar", f"{out}/s-00002.tar"))
    assert rest.count() == 40


def test_table_function_reads_ranges_of_archives(spark, archive):
    out, index, _ = archive
    tar.register_functions(spark)
    index.withColumn("part", F.expr("offset div 4096")).createOrReplaceTempView("tar_test_index")
    found = spark.sql("SELECT part, name, size, content FROM tar_members(TABLE(tar_test_index) PARTITION BY (shard, part) ORDER BY offset)").collect()
    assert len(found) == 40 and all(len(r.content) == r.size for r in found)
    assert spark.sql("SELECT count(*) AS n FROM tar_members(TABLE(tar_test_index) PARTITION BY shard)").first().n == 40
    with pytest.raises(PySparkException, match="needs a column offset"):
        spark.sql("SELECT * FROM tar_members(TABLE(SELECT 'x' AS shard) PARTITION BY shard)").collect()
    with pytest.raises(PySparkException, match="takes a table"):
        spark.sql("SELECT * FROM tar_members('x')").collect()
