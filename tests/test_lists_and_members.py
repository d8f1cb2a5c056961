"""Merged shard lists, manifests in parts, micro-batches and packed members."""

from __future__ import annotations

import gzip
import io
import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom.operators import buckets
from shardloom.operators.index import positions
from shardloom.sources import descriptors, files


def test_merged_list_keeps_list_order(spark):
    rows = [(2, 5, "c"), (1, 900, "b"), (1, 3, "a"), (7, 0, "f"), (2, 6, "d"), (2, 70_000, "e")]
    lines = spark.createDataFrame(rows, "source_no int, pos long, url string").repartition(4)
    got = descriptors.merged_list(lines)
    assert got.columns == ["source_no", "pos", "url", "ordinal"]
    assert [r.url for r in sorted(got.collect(), key=lambda r: r.ordinal)] == list("abcdef")
    assert sorted(r.ordinal for r in got.collect()) == list(range(6))
    assert descriptors.merged_list(lines.limit(0)).count() == 0


def test_manifest_in_parts(spark, tmp_path):
    numbers = [7 * i for i in range(1000)]
    listed = spark.createDataFrame([(n,) for n in numbers], "n long").repartition(5)
    placed = positions(listed, "n", name="ordinal").withColumn("value", F.col("n") % 900)
    files.write_holdout_parts(placed, str(tmp_path / "m"), "ordinal", "value", 5000, part_values=64)
    lines = [json.loads(x) for p in (tmp_path / "m").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 16 and max(len(x["exclude_indices"]) for x in lines) == 64
    assert {x["source_sample_count"] for x in lines} == {5000}
    got = sorted((r.ordinal, int(r.value)) for r in files.read_holdout_parts(spark, str(tmp_path / "m")).collect())
    assert got == [(i, n % 900) for i, n in enumerate(numbers)]


def test_a_manifest_with_a_lost_or_doubled_part_is_refused(spark, tmp_path):
    def part(name, first, values):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{first}-{len(values)}.json").write_text(json.dumps({"format_version": 1, "first_ordinal": first, "exclude_indices": values}) + "\n")

    part("gap", 0, [1, 2])
    part("gap", 4, [5])
    part("twice", 0, [1, 2])
    part("twice", 0, [3])
    for name in ("gap", "twice"):
        with pytest.raises(ValueError, match="Manifest parts"):
            files.read_holdout_parts(spark, str(tmp_path / name))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.json").write_text("{not json\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE"):
        files.read_holdout_parts(spark, str(tmp_path / "broken")).collect()


def test_micro_batches_are_joined_before_they_are_stacked(spark):
    sample = "struct<x:int,y:string,metadata:struct<seed:long,tags:array<string>>>"
    rows = [
        (0, 3, "r", 0, True, [(1, "a", (10, ["p"])), (2, "b", (11, []))]), (0, 1, "r", 0, True, [(3, "c", (12, None))]), (0, 2, "r", 0, True, []),
        (0, 4, "r", 0, True, None), (0, 5, "r", 0, True, [None, (4, None, None)]), (1, 9, "r", 0, False, []),
    ]
    batched = spark.createDataFrame(rows, f"rank int, idx long, ratio string, batch_no long, full boolean, micro array<{sample}>")
    got = {r["rank"]: r for r in buckets.collate_micro(batched, "idx", "micro").collect()}
    first = got[0]
    assert (first.samples, first.emit_at, first.x, first.y) == (4, 5, [3, 1, 2, 4], ["c", "a", "b", None])
    assert first.metadata.seed == [12, 10, 11, None] and first.metadata.tags == [None, ["p"], [], None]
    assert (got[1].samples, got[1].x) == (0, [])


def npy(values, dtype="float32"):
    buffer = io.BytesIO()
    np.save(buffer, np.asarray(values, dtype=dtype))
    return buffer.getvalue()


def test_members_of_every_kind_plain_and_packed(spark):
    plain = {"a.txt": b"caf\xc3\xa9", "b.cls": b" 17\n", "c.json": b'{"k": [1]}', "d.npy": npy([[1, 2, 3], [4, 5, 6]]), "e.npy": npy(7.5), "f.npy": npy([], "int64"), "g.bin": b"\x00\x01"}
    rows = [*plain.items(), *[(f"{n}.gz", gzip.compress(c)) for n, c in plain.items()], ("h.txt", None), ("i.npy", None), ("gz", gzip.compress(b"x"))]
    got = {r["name"]: r for r in files.decode_members(spark.createDataFrame(rows, "name string, content binary")).collect()}
    for tail in ("", ".gz"):
        assert got[f"a.txt{tail}"].as_text == "café" and got[f"b.cls{tail}"].as_class == 17
        assert got[f"c.json{tail}"].as_json is not None and bytes(got[f"g.bin{tail}"].content) == b"\x00\x01"
        assert got[f"d.npy{tail}"].as_npy == ([2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
        assert got[f"e.npy{tail}"].as_npy == ([], [7.5]) and got[f"f.npy{tail}"].as_npy == ([0], [])
    assert got["h.txt"].as_text is None and (got["i.npy"].as_npy is None or got["i.npy"].as_npy.shape is None)


def test_pickles_are_never_opened(spark):
    rows = [("x.pkl", b"1"), ("y.pickle.gz", b"not even gzip"), ("z.txt", b"fine")]
    members = spark.createDataFrame(rows, "name string, content binary")
    with pytest.raises(PySparkException, match="Pickle members are refused"):
        files.decode_members(members).collect()
    got = {r["name"]: (r.refused, r.content) for r in files.decode_members(members, on_pickle="list").collect()}
    assert got == {"x.pkl": (True, None), "y.pickle.gz": (True, None), "z.txt": (False, bytearray(b"fine"))}
    objects = io.BytesIO()
    np.save(objects, np.array([{}], dtype=object))
    with pytest.raises(PySparkException, match="allow_pickle"):
        files.decode_members(spark.createDataFrame([("o.npy", objects.getvalue())], "name string, content binary")).collect()
