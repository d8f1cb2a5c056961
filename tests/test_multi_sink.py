"""A stream into several tables, broken off in all the places where it hurts."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shardloom.streaming import incremental, multi_sink
from shardloom.streaming.multi_sink import Sink

SCHEMA = "id long, key string, label string, payload string"


def write_inputs(spark, folder, n=4, start=0):
    for i in range(start, n):
        rows = [(10 * i + j, f"k{(10 * i + j) % 12}", f"l{10 * i + j}", None if j == 7 else f"p{10 * i + j}") for j in range(10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def sinks(fail=None):
    def rejects(batch):
        if fail and fail(batch):
            raise OSError("stopped between two sinks")
        return batch.where("payload IS NULL").select("id", F.lit("no payload").alias("reason"))

    return [
        Sink("images", lambda b: b.where("payload IS NOT NULL").select("key", "id", "payload"), ("key",), ("id",), "first"),
        Sink("rejects", rejects),
        Sink("labels", lambda b: b.where("payload IS NOT NULL").select("key", "id", "label"), ("key",), ("id",), "last"),
    ]


def run(spark, tmp_path, name, chosen=None, config=None, state=None):
    stream = incremental.open_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return multi_sink.convert(stream, str(tmp_path / name / "out"), str(tmp_path / (state or name) / "state"), config or {"r": 1}, chosen or sinks())


def tables(found):
    return {name: sorted(map(tuple, df.collect())) for name, df in found.items()}


def expected(n=4):
    rows = [(i, f"k{i % 12}", f"l{i}", None if i % 10 == 7 else f"p{i}") for i in range(10 * n)]
    good = [r for r in rows if r[3]]
    images = {k: next((k, i, p) for i, key, _, p in good if key == k) for k in {r[1] for r in good}}
    labels = {k: [(k, i, x) for i, key, x, _ in good if key == k][-1] for k in images}
    return {"images": sorted(images.values()), "labels": sorted(labels.values()), "rejects": sorted((r[0], "no payload") for r in rows if not r[3])}


def test_all_tables_of_an_unbroken_run(spark, tmp_path):
    write_inputs(spark, tmp_path / "in")
    assert tables(run(spark, tmp_path, "a")) == expected()
    assert tables(run(spark, tmp_path, "a")) == expected()  # nothing new
    write_inputs(spark, tmp_path / "in", 6, 4)
    assert tables(run(spark, tmp_path, "a")) == expected(6)


def test_stopped_between_two_sinks_and_resumed(spark, tmp_path):
    write_inputs(spark, tmp_path / "in")
    calls = []

    def third(batch):
        calls.append(batch.isStreaming)
        return calls.count(False) == 3

    with pytest.raises(StreamingQueryException, match="stopped between two sinks"):
        run(spark, tmp_path, "a", sinks(third))
    out = tmp_path / "a" / "out"
    assert (out / "images" / "batch=2").exists() and not (out / "labels" / "batch=2").exists()
    # A reader sees the two committed batches in all tables, and the third in none.
    chosen = sinks()
    some = spark.createDataFrame([], SCHEMA)
    seen = {s.name: multi_sink.read(spark, str(out), s, s.rows(some).schema) for s in chosen}
    ids = {r.id for r in spark.read.parquet(str(out / "images" / "batch=2")).collect()}
    assert ids and not ids & {r.id for df in seen.values() for r in df.collect()}
    assert seen["rejects"].count() == 2
    assert tables(run(spark, tmp_path, "a")) == expected()


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    write_inputs(spark, tmp_path / "in", 2)
    run(spark, tmp_path, "a")
    # The driver died after the commit and before the stream wrote down its progress.
    progress = tmp_path / "a" / "state" / "checkpoint" / "commits"
    last = max(progress.glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (progress / f".{last.name}.crc").unlink(missing_ok=True)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a" / "out").rglob("*.parquet")}
    assert tables(run(spark, tmp_path, "a")) == expected(2)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "a" / "out").rglob("*.parquet")} == before


def test_refusals(spark, tmp_path):
    write_inputs(spark, tmp_path / "in", 1)
    run(spark, tmp_path, "a")
    with pytest.raises(ValueError, match="settings changed"):
        run(spark, tmp_path, "a", config={"r": 2})
    with pytest.raises(ValueError, match="settings changed"):
        run(spark, tmp_path, "a", sinks()[:2])
    with pytest.raises(ValueError, match="another checkpoint"):
        run(spark, tmp_path, "a", state="fresh")
    with pytest.raises(ValueError, match="names of their own"):
        run(spark, tmp_path, "b", [sinks()[0]] * 2)


def test_a_sink_without_rows_is_an_empty_table(spark, tmp_path):
    Path(tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "k", "l", "p")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    found = run(spark, tmp_path, "a")
    assert found["rejects"].count() == 0 and found["rejects"].columns == ["id", "reason"] and found["images"].count() == 1
