"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["samples"] for r in rows) > 0


@pytest.mark.parametrize(
    "name, order",
    [
        ("t2_global_sort", lambda r: r.key),
        ("a9_timer_shares", lambda r: -r.mean_ms),
        ("r3_shard_shuffle", lambda r: (r.shard_order, r.shard, r.row_order, r.idx)),
    ],
)
def test_rows_come_in_order_where_order_is_the_result(spark, name, order):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) > 3 and rows == sorted(rows, key=order)
