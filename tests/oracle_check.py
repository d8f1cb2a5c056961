"""Run registered queries beside their SQL in DuckDB and compare rows.

``python -m tests.oracle_check /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


EXACT = os.environ.get("ORACLE_EXACT") == "1"  # doubles bit by bit instead of nine digits


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if EXACT else float(f"{value:.9g}") + 0.0
    return value


def _rows(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in frame_rows), key=repr)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    wrong = [f"{c}: {t} vs {kinds[c]}" for c, t in df.dtypes if _KINDS.get(t) and kinds[c] != _KINDS[t]]
    if wrong:
        return f"types differ: {wrong}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    a, b = _rows([tuple(r) for r in got], df.columns), _rows(expected, columns)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {str(x)[:500]} != {str(y)[:500]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from shardloom.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, query, oracle.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "" if name in oracle else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{kind} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
