"""Faults of the third round of findings, each on the smallest input that shows it."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shardloom.llm import simhash, substring_dedup
from shardloom.operators import index as ix
from shardloom.operators import joins, routing, routing_blocks
from shardloom.operators.verify import member_flags
from shardloom.sources import tar


def test_cyclic_zip_takes_any_number_of_documents(spark, tmp_path):
    spark.range(52).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    names = spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("n"), "id").alias("n_name"))
    names.write.parquet(f"{tmp_path}/nation.parquet")
    got = entry.queries()["j10_cyclic_zip"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(i, f"n{i % 25}") for i in range(52)]


def test_cyclic_zip_of_whole_rounds_still_checks_the_counts(spark):
    tiles, labels = spark.range(7).toDF("pos"), spark.range(3).select(F.col("id").alias("pos"), F.col("id").alias("label"))
    with pytest.raises(PySparkException, match="multiple"):
        joins.cyclic_zip(tiles, labels, ix.total_rows(tiles), ix.total_rows(labels)).collect()


def _meetings(ids, own, protos, others) -> dict:
    return {"asking": [len(ids)], "held": [len(protos)]}


def test_a_block_meets_a_set_of_blocks_at_once(spark):
    rnd = np.random.default_rng(5)
    frames = [spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(n)], "id long, vec array<double>") for n in (300, 120)]
    pivots = routing_blocks.draw_pivots(frames[1], 40)
    left, n_left = routing_blocks.vector_blocks(frames[0], pivots, "left", 10)
    right, n_right = routing_blocks.vector_blocks(frames[1], pivots, "right", 10)
    pairs = routing_blocks.all_pairs(left, n_right)
    met = routing_blocks.compare(left, right, pairs, _meetings, "asking long, held long").collect()
    assert sum(r.asking * r.held for r in met) == 300 * 120
    assert len(met) <= n_left < pairs.count() / 10


def test_small_sets_give_the_same_rows(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    given = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(150)], "vec_id long, vec array<double>")
    protos = spark.createDataFrame([(i, rnd.normal(size=4).round(1).tolist()) for i in range(60)], "proto long, vec array<double>")
    rows = lambda **kw: sorted(tuple(r)[:1] + tuple(r)[2:] for r in routing.assign(given, protos, "vec_id", **kw).collect())
    shipped = rows(in_blocks=False)
    monkeypatch.setattr(routing_blocks, "PART_BYTES", (400, 400))
    monkeypatch.setattr(routing_blocks, "HELD_BYTES", 300)
    assert rows(in_blocks=True, block_rows=5) == shipped


def _parts(spark, n, tasks, mode, folder, ranged=True, shards=2):
    tar.register(spark)
    rows = spark.range(n).select(F.format_string("s%d.tar", F.col("id") % shards).alias("shard"), F.format_string("%05d", "id").alias("key"))
    rows = rows.withColumn("txt", F.encode("key", "UTF-8"))
    dealt = rows.repartitionByRange(tasks, "shard", "key") if ranged else rows.repartition(tasks, "txt")
    dealt.sortWithinPartitions("shard", "key").write.format("tarshards").option("parts", "true").mode(mode).save(folder)
    found = spark.read.format("tarshards").option("parts", "true").load(folder)
    return sorted((r.shard.rsplit("/", 1)[1], r.member_ordinal, r.name) for r in found.withColumn("shard", tar.shard_of_part(F.col("shard"))).collect())


def test_a_shard_is_written_by_several_tasks(spark, tmp_path):
    folder = f"{tmp_path}/out"
    wanted = sorted((f"s{i % 2}.tar", i // 2, f"{i:05d}.txt") for i in range(600))
    with spark_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        assert _parts(spark, 600, 6, "append", folder) == wanted
        assert len(os.listdir(folder)) > 5
        assert _parts(spark, 600, 3, "overwrite", folder) == wanted  # other parts than before, none of the old beside them
        assert len(os.listdir(folder)) < 6
        with pytest.raises(PySparkException, match="exists"):
            _parts(spark, 600, 5, "append", folder)
        with pytest.raises(PySparkException, match="several tasks"):
            _parts(spark, 600, 4, "overwrite", folder, ranged=False)


class spark_conf:
    def __init__(self, spark, key, value):
        self.conf, self.key, self.value = spark.conf, key, value

    def __enter__(self):
        self.before = self.conf.get(self.key)
        self.conf.set(self.key, self.value)

    def __exit__(self, *_):
        self.conf.set(self.key, self.before)


def test_many_blocks_and_archives_are_read_in_few_partitions(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/out"
    rows = spark.range(400).select("id", F.format_string("k%05d", "id").alias("key"), F.encode(F.repeat(F.lit("x"), 600), "UTF-8").alias("v"))
    tar.write_shards(rows, folder, "id", {"txt": "v"}, shard_size=20)
    blocks = tar.member_blocks(tar.member_index(spark, folder, f"{tmp_path}/index"), f"{tmp_path}/blocks", 2048)
    assert spark.read.parquet(blocks).count() > 100
    monkeypatch.setattr(tar, "PARTITIONS", 4)
    for given in (None, blocks):
        reader = tar.TarShardReader(tar.StructType(), {"path": folder} | ({"blocks": given} if given else {}))
        assert 4 <= len(reader.partitions()) <= 6
    whole = {(r.shard, r.member_ordinal, r.name) for r in tar.read_members(spark, folder).collect()}
    cut = [(r.shard, r.member_ordinal, r.name) for r in tar.read_members(spark, folder, blocks=blocks).collect()]
    assert len(whole) == 400 == len(cut) and set(cut) == whole


def test_a_record_is_not_parsed_anew_for_each_text(spark):
    rows = [("a", '{"prompt": "x y", "texts": ["x", "y"]}'), ("b", '{"prompt": "x", "texts": ["x", "y"]}'), ("c", '{"texts": ["x"]}'), ("d", "no")]
    members = spark.createDataFrame([("s", k, "json", 1, 1, r) for k, r in rows], "shard string, key string, ext string, width int, height int, record string")
    flags = member_flags(members)
    assert {r.key: r["text not in prompt"] for r in flags.collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lambda" in plan and plan.count("Contains(") == plan.count("Contains(lambda")


def _exchanged_bytes(df) -> int:
    """Bytes of rows that the exchanges of the collected plan took, each exchange once."""

    def below(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return below(node.plan())
        children = [node.children().apply(i) for i in range(node.children().size())]
        return (node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0) + sum(map(below, children))

    return below(df._jdf.queryExecution().executedPlan())


def _texts_with_copies(spark, n=400, copies=20):
    rnd = random.Random(12)
    texts = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(300)) for _ in range(n)]
    texts += texts[:copies]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, texts, sum(map(len, texts))


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of any size
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_that_stay_are_not_exchanged_for_the_copies(spark, no_broadcasts):
    docs, texts, n_bytes = _texts_with_copies(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert _exchanged_bytes(kept) < 0.3 * n_bytes


@pytest.mark.parametrize("max_bits", [1 << 27, 1 << 15])
def test_a_bitmap_parts_rows_and_loses_no_key(spark, max_bits):
    rows = spark.range(30_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id % 7 = 3").select("h")
    clear, others = simhash._parted(rows, F.col("h"), keys, "__", max_bits)
    clear, others = ({r.id for r in x.collect()} for x in (clear, others))
    assert clear.isdisjoint(others) and len(clear) + len(others) == 30_000
    assert others >= set(range(3, 30_000, 7))
    assert len(clear) > (25_000 if max_bits > 1 << 15 else 20_000)
    assert not simhash._parted(rows, F.col("h"), keys.limit(0), "__")[1].count()


def test_a_text_that_comes_along_is_exchanged_once(spark, no_broadcasts):
    docs, texts, n_bytes = _texts_with_copies(spark)
    odd = [(-1, None), (-2, ""), (-3, "  a \n b ")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = substring_dedup.dedup(docs, carry=("text",))
    rows = {r.doc_id: r for r in found.collect()}
    assert {i: r.text for i, r in rows.items()} == dict(enumerate(texts)) | dict(odd)
    assert all(rows[400 + i].n_removed == 300 and rows[i].n_removed == 0 for i in range(20))
    plain = substring_dedup.dedup(docs)
    plain.collect()
    assert _exchanged_bytes(found) < _exchanged_bytes(plain) + 0.3 * n_bytes
