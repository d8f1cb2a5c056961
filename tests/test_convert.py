"""The whole conversion: parquet rows to verified shards, resumed through the ledger."""

import json

import pytest
from pyspark.errors import PySparkException

from shardloom.plans import convert as conversion
from shardloom.sources import descriptors, tar

SCHEMA = (
    "image struct<bytes:binary,path:string>, caption string, "
    "annotations array<struct<polygon:array<array<float>>,text:string,valid:boolean,rec_score:double>>, "
    "image_width int, image_height int, img_name string"
)


def jpeg(width, height):
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + bytes(9) + b"\xff\xd9"


def row(i, declared=None):
    texts = [([[0.0, 0.0]], f"T{k}", None if k else True, 0.9) for k in range(i % 4)]
    return ((jpeg(100 + i, 50), f"p{i}"), f"a * caption {i}.", texts, declared if declared else 100 + i, None, f"img{i}")


def write(spark, folder, name, rows):
    path = folder / "staging" / name
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path))
    part = next(path.glob("part-*.parquet"))
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{name}.parquet").write_bytes(part.read_bytes())


def test_conversion_end_to_end(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, tmp_path, "train-a", [row(i) for i in range(23)])
    ledger = conversion.convert(spark, source, output, shard_size=10).collect()
    assert [(r["name"], r.status, r.rows, r.shards) for r in ledger] == [("train-a.parquet", "complete", 23, 3)]
    assert conversion.verify(spark, output).collect() == []

    write(spark, tmp_path, "train-b", [row(i) for i in range(5)])
    ledger = conversion.convert(spark, source, output, shard_size=10).collect()
    assert {r["name"]: r.rows for r in ledger} == {"train-a.parquet": 23, "train-b.parquet": 5}
    assert conversion.verify(spark, output).collect() == []
    lines = descriptors.read_descriptor(spark, f"{output}/descriptor.json").collect()
    assert [(r.url.removeprefix(output + "/"), r.nsamples) for r in lines] == [
        ("shards/train-a-00000.tar", 10), ("shards/train-a-00001.tar", 10), ("shards/train-a-00002.tar", 3), ("shards/train-b-00000.tar", 5),
    ]
    samples = tar.assemble_samples(tar.read_members(spark, f"{output}/shards"))
    record = json.loads(bytes(samples.where("key like '%train-a-000000006'").first()["members"][".json"]))
    assert record["prompt"] == 'a caption 6, with the visible words "T0" and "T1" clearly rendered in the image.'
    assert (record["width"], record["height"], record["wm_score"], record["source_row"]) == (106, 50, None, 6)

    first = tmp_path / "in" / "train-a.parquet"
    first.write_bytes((tmp_path / "in" / "train-b.parquet").read_bytes())
    with pytest.raises(PySparkException, match="fingerprint changed"):
        conversion.convert(spark, source, output, shard_size=10)


def test_verification_finds_damage(spark, tmp_path):
    folder = str(tmp_path / "out" / "shards")
    good = json.dumps({f: "" for f in ("prompt", "original_caption", "source_parquet", "source_row")} | {"texts": ["no"], "annotations": [], "width": 9, "height": 5})
    rows = spark.createDataFrame([(0, "k0", jpeg(10, 5), good.encode()), (1, "k1", jpeg(1, 1), None)], "i bigint, key string, img binary, rec binary")
    tar.write_shards(rows, folder, "i", {"jpg": "img", "json": "rec"}, "s", may_lack={"json"})
    spark.createDataFrame([("s", "shards/s-00000.tar", 3)], conversion.SHARD_LIST).write.parquet(str(tmp_path / "out" / "shard-list" / "run=0"))
    found = {(r.key, r.rule) for r in conversion.verify(spark, str(tmp_path / "out")).collect()}
    assert found == {("k0", "text not in prompt"), ("k0", "sizes differ"), ("k1", "incomplete pair"), (None, "wrong count")}


def test_conversion_stops_on_wrong_size(spark, tmp_path):
    write(spark, tmp_path, "train-a", [row(0), row(1, declared=7)])
    with pytest.raises(PySparkException, match="width disagrees"):
        conversion.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_a_lost_shard_stops_the_resume(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, tmp_path, "train-a", [row(i) for i in range(23)])
    conversion.convert(spark, source, output, shard_size=10)
    (tmp_path / "out" / "shards" / "train-a-00001.tar").rename(tmp_path / "elsewhere.tar")
    with pytest.raises(PySparkException, match="shard missing"):
        conversion.convert(spark, source, output, shard_size=10)


def test_a_run_that_broke_off_is_redone(spark, tmp_path, monkeypatch):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, tmp_path, "train-a", [row(i) for i in range(5)])
    with monkeypatch.context() as broken:
        broken.setattr(conversion, "write_top_descriptor", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            conversion.convert(spark, source, output)
    assert not (tmp_path / "out" / "ledger").exists()
    assert [r.status for r in conversion.convert(spark, source, output).collect()] == ["complete"]
    assert (tmp_path / "out" / "descriptor.json").exists() and conversion.verify(spark, output).collect() == []
    (tmp_path / "out" / "descriptor.json").rename(tmp_path / "old.json")
    conversion.convert(spark, source, output)
    assert (tmp_path / "out" / "descriptor.json").exists()


def test_an_input_that_changes_while_read_is_not_listed(spark, tmp_path, monkeypatch):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, tmp_path, "train-a", [row(i) for i in range(5)])
    write(spark, tmp_path, "train-b", [row(i) for i in range(6)])
    real = conversion.tar.write_shards

    def change_meanwhile(*args, **kwargs):
        out = real(*args, **kwargs)
        (tmp_path / "in" / "train-a.parquet").write_bytes((tmp_path / "in" / "train-b.parquet").read_bytes())
        return out

    monkeypatch.setattr(conversion.tar, "write_shards", change_meanwhile)
    with pytest.raises(ValueError, match="train-a.parquet: changed"):
        conversion.convert(spark, source, output)
    assert not (tmp_path / "out" / "shard-list").exists() and not (tmp_path / "out" / "ledger").exists()


def test_null_payloads_and_undecodable_images_stop_the_job(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, "k0", b"x"), (1, "k1", None)], "i bigint, key string, img binary")
    with pytest.raises(PySparkException, match="k1.jpg has no payload"):
        tar.write_shards(rows, str(tmp_path / "shards"), "i", {"jpg": "img"}, "s")
    assert list((tmp_path / "shards").iterdir()) == []
    write(spark, tmp_path, "train-a", [row(0)])
    cut = lambda payload: F.when(F.octet_length(payload) < 1000, "image is cut off")
    with pytest.raises(PySparkException, match="cut off"):
        conversion.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), decode=cut)


def test_a_broken_cached_table_is_built_anew(spark, tmp_path):
    from shardloom.sources.sinks import cached_table

    path = str(tmp_path / "cache")
    assert cached_table(spark, path, lambda: spark.range(3)).count() == 3
    for part in (tmp_path / "cache").glob("part-*"):
        part.write_bytes(b"garbage")
    assert cached_table(spark, path, lambda: spark.range(4)).count() == 4
    assert cached_table(spark, path, lambda: spark.range(9)).count() == 4
