"""Properties that hold whatever the data: complete, disjoint, repeatable, skew-proof."""

import gzip
import io
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom.operators import buckets, sampling, splits
from shardloom.operators import index as ix
from shardloom.plans import registry
from shardloom.session import scratch_path
from shardloom.sources import descriptors, files, ledger, tar
from shardloom.streaming import batcher, incremental


def indexed(spark, n, parts=5):
    return spark.range(n).withColumnRenamed("id", "i").repartition(parts)


def test_positions_with_a_hot_key(spark):
    rows = indexed(spark, 5000).withColumn("k", F.when(F.col("i") % 3 == 0, F.lit(0)).otherwise(F.col("i") % 97))
    got = ix.positions(rows, "i", ("k",), "pos", "size", block_rows=256).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.i, r.pos, r.size))
    assert sum(map(len, by_key.values())) == 5000
    for members in by_key.values():
        members.sort()
        assert [m[1] for m in members] == list(range(len(members)))
        assert {m[2] for m in members} == {len(members)}


def test_locate_with_uneven_and_empty_shards(spark):
    sizes = [0, 1, 1, 9000, 0, 3, 4096, 1]
    shards = spark.createDataFrame(list(enumerate(sizes)), "ordinal bigint, nsamples bigint")
    total = sum(sizes)
    rows = indexed(spark, total + 10)
    got = {r.i: (r.ordinal, r.i - r.start) for r in ix.locate(rows, "i", ix.shard_ranges(shards), 64).collect()}
    expected, at = {}, 0
    for number, size in enumerate(sizes):
        for inner in range(size):
            expected[at] = (number, inner)
            at += 1
    assert got == expected


@pytest.mark.parametrize("excluded", [[], [0], [9], [0, 1, 2], [3, 3, 7], list(range(10))])
def test_dense_renumber(spark, excluded):
    drop = spark.createDataFrame([(e,) for e in excluded], "i bigint")
    got = sorted((r.i, r.new_index) for r in ix.dense_renumber(indexed(spark, 10), "i", drop, 10).collect())
    kept = [i for i in range(10) if i not in excluded]
    assert got == [(old, new) for new, old in enumerate(kept)]


@pytest.mark.parametrize("outside", [50, 10, -1])
def test_dense_renumber_refuses_what_is_out_of_range(spark, outside):
    drop = spark.createDataFrame([(3,), (outside,)], "i bigint")
    with pytest.raises(ValueError, match=f"out of range: {outside}"):
        ix.dense_renumber(indexed(spark, 10), "i", drop, 10)


@pytest.mark.parametrize("n, ranks", [(10, 3), (9, 3), (2, 5), (1, 4)])
def test_splits_are_complete(spark, n, ranks):
    rows, total = indexed(spark, n, 2), F.lit(n)
    chunked = splits.chunked(rows, "i", total, ranks).collect()
    assert sorted(r.i for r in chunked) == list(range(n))
    ranged = splits.ranged(rows, "i", total, ranks).collect()
    assert sorted(r.i for r in ranged) == list(range(n // ranks * ranks))
    size = -(-n // ranks)
    for split in (splits.local, splits.strided):
        got = split(rows, "i", total, ranks).collect()
        assert sorted(r.pos for r in got) == list(range(size * ranks))
        assert all(r.i == r.pos % n for r in got)
        assert {sum(r.rank == k for r in got) for k in range(ranks)} == {size}


def test_batches_are_homogeneous_and_in_order(spark):
    rows = indexed(spark, 3000).select(
        "i", (F.col("i") % 2).alias("rank"), F.when(F.col("i") % 3 == 0, "hot").otherwise((F.col("i") % 11).cast("string")).alias("ratio")
    )
    packed = buckets.collate(buckets.same_bucket_batches(rows, "i", 16, drop_last=False, block_rows=128), "i", [])
    seen = []
    for r in packed.collect():
        assert r.i == sorted(r.i) and r.emit_at == r.i[-1] and (len(r.i) == 16) == r.full
        seen += r.i
    assert sorted(seen) == list(range(3000))


def test_draws_do_not_depend_on_partitioning(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    a = sorted((r.i, r.position) for r in sampling.permutation(indexed(spark, 400, 7), "i", 400, 5, 1).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    b = sorted((r.i, r.position) for r in sampling.permutation(indexed(spark, 400, 2), "i", 400, 5, 1).collect())
    assert a == b and sorted(p for _, p in a) == list(range(400))
    c = [r.position for r in sampling.permutation(indexed(spark, 400), "i", 400, 5, 2).orderBy("i").collect()]
    assert c != [p for _, p in a]


def test_weighted_choice_follows_the_weights(spark):
    scores = spark.range(20000).select(
        F.col("id").alias("key"), F.posexplode(F.array(F.lit(0.9), F.lit(0.3), F.lit(0.1))).alias("ordinal", "score")
    ).withColumn("caption_type", F.concat(F.lit("t"), F.col("ordinal").cast("string")))
    drawn = sampling.weighted_caption(scores, ["key"], 0.2, 1.0, 3).groupBy("caption_type").count().collect()
    share = {r["caption_type"]: r["count"] / 20000 for r in drawn}
    assert set(share) == {"t0", "t1"} and abs(share["t0"] - 0.75) < 0.015


def test_weighted_choice_falls_back(spark):
    scores = spark.createDataFrame([(1, 0, "a", 0.1), (1, 1, "b", 0.4), (1, 2, "c", 0.4)], "key int, ordinal int, caption_type string, score double")
    assert [tuple(r) for r in sampling.weighted_caption(scores, ["key"], 0.9, 1.0, 3).collect()] == [(1, "b", 0.4)]


def test_expand_counts_spreads_big_counts(spark):
    counts = spark.createDataFrame([("hot", 1000), ("one", 1), ("none", 0)], "k string, n bigint")
    got = ix.expand_counts(counts, "n", "j", chunk=64).groupBy("k").agg(F.count("*").alias("c"), F.sum("j").alias("s")).collect()
    assert {(r.k, r.c, r.s) for r in got} == {("hot", 1000, 499500), ("one", 1, 0)}


def test_tar_round_trip(spark):
    rng = random.Random(4)
    payloads = {i: bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 511, 512, 513, 3000]))) for i in range(37)}
    rows = spark.createDataFrame([(i, f"k{i:03d}", p, b"{}") for i, p in payloads.items()], "i bigint, key string, img binary, rec binary")
    folder = scratch_path(spark, "tars")
    written = tar.write_shards(rows.repartition(5), folder, "i", {"jpg": "img", "json": "rec"}, shard_size=10)
    assert sorted(r.nsamples for r in written.collect()) == [7, 10, 10, 10]
    members = tar.read_members(spark, folder)
    assert members.count() == 74
    samples = tar.assemble_samples(members).collect()
    assert {int(s["key"][1:]): bytes(s["members"][".jpg"]) for s in samples} == payloads
    assert tar.read_members(spark, folder, extensions="json").count() == 37
    ordered = members.where("shard like '%-00001.tar'").orderBy("member_ordinal").select("name").collect()
    assert [r.name for r in ordered][:3] == ["k010.jpg", "k010.json", "k011.jpg"]
    index_path = scratch_path(spark, "index")
    index = tar.member_index(spark, folder, index_path).collect()
    for r in index:
        if r.name.endswith(".jpg"):
            with open(r.shard, "rb") as f:
                f.seek(r["offset"])
                assert f.read(r["size"]) == payloads[int(r.name[1:4])]


def test_decode_packed_members_and_refuse_pickle(spark):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6).reshape(2, 3))
    rows = spark.createDataFrame(
        [("a.txt.gz", gzip.compress("héllo".encode())), ("b.cls", b" 12\n"), ("c.json", b'{"x": 1}'), ("d.bin", b"\x00\xff"), ("e.npy", buffer.getvalue())],
        "name string, content binary",
    )
    got = {r["name"]: r for r in files.decode_members(rows).select("name", "as_text", "as_class", F.col("as_json").cast("string").alias("j"), "content").collect()}
    assert got["a.txt.gz"].as_text == "héllo" and got["b.cls"].as_class == 12 and got["c.json"].j == '{"x":1}'
    assert bytes(got["d.bin"].content) == b"\x00\xff"
    values = rows.where("name = 'e.npy'").select(files.npy_values("content").alias("v")).first()["v"]
    assert values == [0, 1, 2, 3, 4, 5]
    with pytest.raises(PySparkException, match="Pickle"):
        files.decode_members(spark.createDataFrame([("x.pkl", b"1")], "name string, content binary")).collect()


def test_file_checks_against_python(spark, tmp_path):
    import hashlib

    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * (1 << 20) + b"tail")
    got = {r["name"]: r for r in files.fingerprint_files(spark, str(tmp_path), "*.bin").collect()}
    for i in range(3):
        data = (tmp_path / f"f{i}.bin").read_bytes()
        assert got[f"f{i}.bin"].sha256 == hashlib.sha256(data).hexdigest() and got[f"f{i}.bin"].md5 == hashlib.md5(data).hexdigest()
    spark.range(100).repartition(2).write.parquet(str(tmp_path / "table"))
    found = files.inventory(spark, str(tmp_path / "table")).collect()
    assert sum(r["rows"] for r in found) == 100 and all(sum(r["row_groups"]) == r["rows"] for r in found)
    capped = files.scan_directory(spark, str(tmp_path / "table"), max_files=1)
    assert capped.count() == min(found, key=lambda r: r["name"])["rows"]
    with pytest.raises(FileNotFoundError):
        files.scan_directory(spark, str(tmp_path / "table"), "none*", 1)


def test_global_index_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(4).write.parquet(path)
    got = [r.global_index for r in ix.with_global_index(spark, path).collect()]
    assert sorted(got) == list(range(1000))


def test_descriptor_rules(spark, tmp_path):
    import json

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text(json.dumps({"wids_version": 1, "name": "part", "shardlist": [{"url": "x.tar", "nsamples": 2}]}))
    doc = {
        "wids_version": 1, "name": "all", "weight": 0.5,
        "shardlist": [{"url": "a/../b.tar", "nsamples": 1}, {"url": "http://h/c.tar", "nsamples": 3, "weight": 2.0}],
        "datasets": [
            {"source_url": str(tmp_path / "sub" / "c.json"), "weight": 7.0},
            {"base": "s3://bucket/d", "name": "inline", "shardlist": [{"url": "e.tar", "nsamples": 4}]},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = [(r.url, r.nsamples, r.weight, r["name"], r.dataset) for r in descriptors.read_descriptor(spark, str(tmp_path / "d.json")).collect()]
    assert got == [
        (f"{tmp_path}/b.tar", 1, 0.5, "all", None), ("http://h/c.tar", 3, 2.0, "all", None),
        (f"{tmp_path}/sub/x.tar", 2, 7.0, None, "part"), ("s3://bucket/d/e.tar", 4, None, None, "inline"),
    ]
    (tmp_path / "bad.json").write_text(json.dumps({"wids_version": 2, "shardlist": [{"url": "a", "nsamples": 1}]}))
    with pytest.raises(PySparkException, match="version"):
        descriptors.read_descriptor(spark, str(tmp_path / "bad.json")).collect()


def test_sidecars_tolerate_broken_files(spark, tmp_path):
    (tmp_path / "s0_cap.json").write_text('{"k": {"short": "x", "long": null}}')
    (tmp_path / "s1_cap.json").write_text("{broken")
    got = [(r.shard, r.key, r.caption_type, r.value) for r in files.read_sidecars(spark, str(tmp_path), "_cap").collect()]
    assert got == [("s0.tar", "k", "short", "x"), ("s0.tar", "k", "long", None)]


def test_ledger_stops_on_changed_input(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, fp string")
    schema = "name string, status string, rows bigint, shards bigint, source_before string, source_after string, completed_at string"
    fine = spark.createDataFrame([("a", "complete", 5, 1, "1", "1", "t")], schema)
    assert [r["name"] for r in ledger.pending_inputs(current, fine).collect()] == ["b"]
    changed = spark.createDataFrame([("a", "complete", 5, 1, "9", "9", "t")], schema)
    with pytest.raises(PySparkException, match="fingerprint changed"):
        ledger.pending_inputs(current, changed).collect()
    newer = ledger.upsert_ledger(fine, changed).collect()
    assert len(newer) == 1 and newer[0]["source_before"] == "9"


def test_conversion_resumes_and_refuses_other_settings(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema

    def run(config):
        return incremental.convert(incremental.open_stream(spark, source, "*.parquet", schema), out, state, config, lambda s: s)

    assert run({"size": 1}).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert run({"size": 1}).count() == 15
    with pytest.raises(ValueError, match="resume refused"):
        run({"size": 2})


def test_conversion_refuses_changed_inputs(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    spark.range(10).coalesce(1).write.parquet(str(source))
    schema = spark.range(1).schema

    def run():
        stream = incremental.open_stream(spark, str(source), "*.parquet", schema)
        return incremental.convert(stream, out, state, {}, lambda s: s, (str(source), "*.parquet")).count()

    assert run() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(str(source))
    assert run() == 15
    first = next(source.glob("*.parquet"))
    first.write_bytes(first.read_bytes() + b"x")
    with pytest.raises(ValueError, match="changed"):
        run()


def test_inserts_are_idempotent_over_batches(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.range(10).coalesce(1).write.parquet(source)
    spark.range(5, 20).coalesce(1).write.mode("append").parquet(source)
    stream = incremental.open_stream(spark, source, "*.parquet", spark.range(1).schema, files_per_batch=1)
    stored = incremental.insert_absent(stream.withColumn("o", F.col("id")), out, state, ["id"], "o")
    assert sorted(r.id for r in stored.collect()) == list(range(20))


def test_stateful_batches_carry_their_rest_over(spark, tmp_path):
    source = str(tmp_path / "in")
    for lo, hi in ((0, 13), (13, 40)):
        spark.range(lo, hi).coalesce(1).write.mode("append").parquet(source)
    stream = incremental.open_stream(spark, source, "*.parquet", spark.range(1).schema, files_per_batch=1)
    keyed = stream.select(F.lit(0).cast("bigint").alias("rank"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("bucket"), F.col("id").alias("idx"))
    done = batcher.run(batcher.batch_stream(keyed, 8), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    members = [int(m) for r in done for m in r.members.split(",")]
    assert len(done) == 6 and sum(r.full for r in done) == 4 and sorted(members) == list(range(40))
    assert sorted((r.batch_no, r.full) for r in done if r.bucket == "even") == [(0, True), (1, True), (2, False)]


def test_latest_checkpoint_prefers_named_steps(spark):
    from shardloom.operators import retention

    schema = "path string, mtime bigint"
    named = spark.createDataFrame([("r/epoch=1-step=5.ckpt", 9), ("r/epoch=0-step=70.ckpt", 1), ("r/last.ckpt", 99)], schema)
    assert retention.latest(named).first()["path"] == "r/epoch=0-step=70.ckpt"
    plain = spark.createDataFrame([("r/a.ckpt", 9), ("r/b.ckpt", 10)], schema)
    assert retention.latest(plain).first()["path"] == "r/b.ckpt"


def test_prompt_files_without_prompts_are_refused(spark, tmp_path):
    (tmp_path / "p.txt").write_text("  a  b \n\n c\n")
    assert sorted(r.prompt for r in files.read_prompts(spark, str(tmp_path / "p.txt")).collect()) == ["a b", "c"]
    (tmp_path / "q.txt").write_text(" \n\n")
    with pytest.raises(ValueError, match="No prompts"):
        files.read_prompts(spark, str(tmp_path / "q.txt"))


def test_registry_rules():
    own = registry.Registry("own")
    own.register("a")(lambda x, y=1: (x, y))
    with pytest.raises(KeyError):
        own.register("a")(lambda: None)
    with pytest.raises(KeyError):
        own.build({"type": "b"})
    assert own.build({"type": "a", "x": 5}, {"x": 1, "y": 2}) == (5, 2)
