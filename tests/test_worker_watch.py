"""Failures of workers: every fault once, whatever the batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException

from shardloom.streaming import incremental, metrics, watch

SCHEMA = "worker string, at timestamp, id long, kind string, n long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = 3600


def event(worker, seconds, number, kind, n=None):
    return worker, None if seconds is None else START + dt.timedelta(seconds=seconds), number, kind, n


def detect(spark, tmp_path, files, name="a", first=0):
    folder = tmp_path / name / "in"
    for rows in files[first:]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = incremental.open_stream(spark, str(folder), "*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    found = watch.detect_failures(stream, "worker", "at", "kind", "n", "id", "10 hours", str(tmp_path / name / "out"), str(tmp_path / name / "state"))
    return sorted((r.worker, r.failure, r.event_id, r.detail) for r in found.collect())


def brute(rows, silence=10 * HOUR, delay=2 * HOUR):
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    heard = max(r[1] for r in rows) - dt.timedelta(seconds=delay)
    out = []
    for worker in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == worker), key=lambda r: (r[1], r[2]))
        session = None
        for (_, at, number, kind, n), after in zip(own, [*own[1:], None]):
            if session is None:
                session = [0, None]
            if kind == "ready":
                session = [0, n]
            elif kind == "progress":
                session[0] += n or 0
            elif kind == "error":
                out.append((worker, "error", number, f"error event {number}"))
            elif kind != "done":
                out.append((worker, "unknown event", number, f"unknown event {kind or 'null'}"))
            if kind == "done":
                if session[0] != session[1]:
                    out.append((worker, "missing total", number, f"completed {session[0]} of {'no total' if session[1] is None else session[1]}"))
                session = None
            elif (after is None and (heard - at).total_seconds() >= silence) or (after and (after[1] - at).total_seconds() > silence):
                out.append((worker, "silent", number, f"silent after {kind or 'null'}"))
                session = None
    return sorted(out)


def test_each_fault_gives_one_line(spark, tmp_path):
    rows = [
        event("good", 0, 1, "ready", 5), event("good", 10, 2, "progress", 2), event("good", 20, 3, "progress", 3), event("good", 30, 4, "done"),
        event("short", 0, 5, "ready", 5), event("short", 10, 6, "progress", 4), event("short", 20, 7, "done"),
        event("odd", 0, 8, "ready", 1), event("odd", 5, 9, "party"), event("odd", 6, 10, None), event("odd", 7, 11, "progress", 1), event("odd", 8, 12, "done"),
        event("broken", 0, 13, "ready", 1), event("broken", 1, 14, "error"), event("broken", 2, 15, "progress", 1), event("broken", 3, 16, "done"),
        event("quiet", 0, 17, "ready", 1), event("unannounced", 5, 18, "done"),
        event(None, 5, 19, "error"), event("timeless", None, 20, "error"),
        event("alive", 30 * HOUR, 21, "ready", None), event("alive", 30 * HOUR, 22, "progress", None),
    ]
    expected = [
        ("broken", "error", 14, "error event 14"), ("odd", "unknown event", 9, "unknown event party"), ("odd", "unknown event", 10, "unknown event null"),
        ("quiet", "silent", 17, "silent after ready"), ("short", "missing total", 7, "completed 4 of 5"), ("unannounced", "missing total", 18, "completed 0 of no total"),
    ]
    assert detect(spark, tmp_path, [rows]) == sorted(expected) == brute(rows)


def test_failures_do_not_depend_on_the_batches(spark, tmp_path):
    rnd = random.Random(11)
    rows, now = [], 0
    for number in range(240):
        now += rnd.choice([60, 600, 4 * HOUR])
        kind = rnd.choice(["ready", "progress", "progress", "done", "error", "dance"])
        rows.append(event(f"w{rnd.randint(0, 5)}", now, number, kind, rnd.choice([1, 2, None])))
    for name, size in (("one", 240), ("many", 60)):
        files = [rnd.sample(rows[i : i + size], size) for i in range(0, 240, size)]
        assert detect(spark, tmp_path, files, name) == brute(rows)


def test_a_resumed_watch_tells_nothing_twice(spark, tmp_path):
    first = [event("a", 0, 1, "ready", 3), event("b", 0, 2, "error"), event("c", 40 * HOUR, 3, "ready", 1)]
    later = [event("c", 41 * HOUR, 4, "done"), event("d", 90 * HOUR, 5, "ready", 1)]
    told = detect(spark, tmp_path, [first])
    assert told == [("a", "silent", 1, "silent after ready"), ("b", "error", 2, "error event 2"), ("b", "silent", 2, "silent after error")]
    assert detect(spark, tmp_path, [first], first=1) == told
    assert detect(spark, tmp_path, [first, later], first=1) == sorted([*told, ("c", "missing total", 4, "completed 0 of 1")])


def test_totals_that_are_not_reached_fail(spark):
    def progress(completed, errors=0, unknown=0):
        return spark.createDataFrame([("w", completed, errors, unknown)], "worker string, completed long, errors long, unknown long")

    assert tuple(metrics.require_success(progress(7), 7).first()) == (7, 0, 0)
    for bad in (progress(6), progress(7, errors=1), progress(7, unknown=1)):
        with pytest.raises(PySparkException, match="Run failed"):
            metrics.require_success(bad, 7).collect()
