"""Tables that are folders of part files: file listings and streams give the rows they give for single files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
#: ``FOLDER_QUERIES=all`` runs every query.
CHOSEN = os.environ.get("FOLDER_QUERIES", "s1_ s4_ s5_ x1_ x2_ x3_ x4_ x5_ x6_ x7_ v1_ flagship").split()
NAMES = [n for n in QUERIES if CHOSEN == ["all"] or any(n.startswith(c) for c in CHOSEN)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for name in os.listdir(SF_DIR):
        rows = spark.read.parquet(f"{SF_DIR}/{name}").coalesce(1)
        n = max(1, rows.count() // 3)
        rows.write.option("maxRecordsPerFile", n).parquet(f"{root}/{name}")
    return str(root)


@pytest.fixture(scope="module")
def con(folders):
    con = duckdb.connect()
    for name in os.listdir(folders):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folders}/{name}/*.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_on_folder_tables(spark, con, folders, name):
    assert len(os.listdir(f"{folders}/events.parquet")) > 3
    problem = compare(spark, con, folders, name, QUERIES[name], ORACLE.get(name))
    assert problem is None, problem


def test_no_match_is_an_error(spark, tmp_path):
    from shardloom.sources import files
    from shardloom.streaming import incremental

    (tmp_path / "other.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.scan_directory(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        incremental.guard_sources(spark, str(tmp_path / "state"), str(tmp_path), "*.parquet")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from shardloom.session import shared_folder

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a")))
