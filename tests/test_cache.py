"""A cache over source files: only what changed is read again, and nothing stale is served."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardloom.sources import cache, files, tar


class Sources:
    """Five parquet files of ten lines and a builder that remembers what it was asked to read."""

    def __init__(self, spark, root):
        self.spark, self.root, self.asked, self.plans = spark, root, [], []
        (root / "in").mkdir()
        for i in range(5):
            self.put(i, f"v{i}")

    def put(self, i, value):
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"n": list(range(10)), "value": [value] * 10}), self.root / "in" / f"f{i}.parquet")

    def build(self, paths):
        self.asked.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        rows = self.spark.read.parquet(*paths)
        found = rows.select("n", F.upper("value").alias("value"), files.file_of_row().alias("source"))
        self.plans.append(found.inputFiles())
        return found

    def listing(self):
        return cache.stamped(files.list_files(self.spark, str(self.root / "in")))

    def get(self, step_files=cache.STEP_FILES):
        path = str(self.root / "cache")
        cache.refresh(self.spark, path, self.listing(), self.build, step_files=step_files)
        found = cache.read(self.spark, path)
        return {r.value: r["count"] for r in found.groupBy("value").count().collect()}


@pytest.fixture
def sources(spark, tmp_path):
    return Sources(spark, tmp_path)


def test_one_file_of_five_changed_four_are_not_read(sources):
    assert sources.get() == {f"V{i}": 10 for i in range(5)}
    assert sources.get() == {f"V{i}": 10 for i in range(5)} and len(sources.asked) == 1
    sources.put(2, "other value")
    assert sources.get() == {"V0": 10, "V1": 10, "OTHER VALUE": 10, "V3": 10, "V4": 10}
    assert sources.asked[1:] == [["f2.parquet"]]
    assert [p.rsplit("/", 1)[1] for p in sources.plans[1]] == ["f2.parquet"]
    path = str(sources.root / "cache")
    read = {p.split("generation=")[1][0] for p in cache.read(sources.spark, path).inputFiles() if "generation=" in p}
    assert read == {"0", "1"}


def test_lines_of_sources_that_are_gone_are_not_served(sources):
    sources.get()
    (sources.root / "in" / "f0.parquet").unlink()
    assert sources.get() == {f"V{i}": 10 for i in range(1, 5)} and len(sources.asked) == 1
    sources.put(7, "seventh")
    assert sources.get()["SEVENTH"] == 10 and sources.asked[1:] == [["f7.parquet"]]
    for i in (1, 2, 3, 4, 7):
        (sources.root / "in" / f"f{i}.parquet").unlink()
    path = str(sources.root / "cache")
    cache.refresh(sources.spark, path, sources.spark.createDataFrame([], "path string, stamp string"), sources.build)
    assert cache.read(sources.spark, path).count() == 0 and cache.read(sources.spark, path).columns == ["n", "value", "source"]
    sources.put(1, "back")
    assert sources.get() == {"BACK": 10}


def test_a_build_that_broke_off_goes_on_from_its_last_step(sources):
    real, calls = sources.build, []

    def fail_third(paths):
        calls.append(paths)
        if len(calls) == 3:
            raise OSError("stopped")
        return real(paths)

    sources.build = fail_third
    with pytest.raises(OSError):
        sources.get(step_files=2)
    sources.build = real
    assert sources.get(step_files=2) == {f"V{i}": 10 for i in range(5)}
    assert sources.asked == [["f0.parquet", "f1.parquet"], ["f2.parquet", "f3.parquet"], ["f4.parquet"]]


def test_rows_written_without_a_switch_are_not_served(sources):
    sources.get()
    sources.put(3, "changed")
    path = str(sources.root / "cache")
    sources.build([str(sources.root / "in" / "f3.parquet")]).write.parquet(f"{path}/rows/generation=1")  # died before the switch
    assert {r.value for r in cache.read(sources.spark, path).collect()} == {f"V{i}" for i in range(5)}
    assert sources.get()["CHANGED"] == 10 and sum(sources.get().values()) == 50


def test_no_sources_and_no_cache_are_errors(spark, tmp_path):
    none = spark.createDataFrame([], "path string, stamp string")
    with pytest.raises(FileNotFoundError):
        cache.refresh(spark, str(tmp_path / "c"), none, lambda paths: None)
    with pytest.raises(FileNotFoundError):
        cache.read(spark, str(tmp_path / "c"))


def test_an_index_follows_its_archives(spark, tmp_path):
    folder, path = str(tmp_path / "tars"), str(tmp_path / "index")
    rows = lambda n: spark.createDataFrame([(i, f"k{i}", b"x" * i) for i in range(n)], "i long, key string, b binary")
    tar.write_shards(rows(20), folder, "i", {"bin": "b"}, shard_size=10)
    assert tar.member_index(spark, folder, path).count() == 20
    tar.write_shards(rows(33), folder, "i", {"bin": "b"}, shard_size=15)  # two archives replaced, one new
    index = tar.member_index(spark, folder, path)
    assert index.count() == 33 and index.groupBy("shard").count().count() == 3
    assert tar.fetch_members(index).where("octet_length(content) <> size").count() == 0


def test_inputs_that_changed_while_they_were_read_stop_the_job(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    before = spark.createDataFrame(files.fingerprint_files(spark, str(tmp_path), "*.txt").collect())
    files.require_unchanged(before, files.fingerprint_files(spark, str(tmp_path), "*.txt"))
    (tmp_path / "a.txt").write_text("two")
    with pytest.raises(ValueError, match="a.txt changed"):
        files.require_unchanged(before, files.fingerprint_files(spark, str(tmp_path), "*.txt"))
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("new")
    assert [r.name for r in files.changed_files(before, files.fingerprint_files(spark, str(tmp_path), "*.txt")).collect()] == ["b.txt"]
