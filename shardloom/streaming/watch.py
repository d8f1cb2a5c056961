"""Failures of workers out of their event stream, with event-time timers and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .metrics import run_append

KINDS = ("ready", "progress", "done", "error")
FAILURES = "worker string, failure string, at_us long, event_id long, detail string"
_STATE = "completed long, total long, last_us long, last_id long, last_kind string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorkerWatch(StatefulProcessor):
    """Follows the sessions of a worker and tells what goes wrong in them.

    A session begins with ``ready`` (amount: the total it has to reach) or with any other event after the end of
    the one before, and ends with ``done`` or by silence.  The state is one line per open session: ``done`` drops
    it at once, and a timer drops it, with a failure, when the worker has said nothing for ``silence_ms``.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _STATE)

    def _silent(self, worker: str, session: tuple) -> tuple:
        return worker, "silent", session[2], session[3], f"silent after {session[4]}"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        worker = key[0]
        # A micro-batch is bounded in bytes, so are the events of one worker in it.
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"], kind="stable")
        session = self.session.get() if self.session.exists() else None
        found = []
        lines = zip(*(events[c].tolist() for c in ("at_us", "event_id", "kind", "amount", "has_amount")))
        for at, number, kind, amount, has_amount in lines:
            if session is not None and at - session[2] > 1000 * self.silence_ms:
                found.append(self._silent(worker, session))
                session = None
            completed, total = session[:2] if session is not None else (0, None)
            if kind == "ready":
                completed, total = 0, int(amount) if has_amount else None
            elif kind == "progress":
                completed += int(amount) if has_amount else 0
            elif kind == "error":
                found.append((worker, "error", at, number, f"error event {number}"))
            elif kind != "done":
                found.append((worker, "unknown event", at, number, f"unknown event {kind}"))
            if kind == "done":
                if completed != total:
                    told = "no total" if total is None else total
                    found.append((worker, "missing total", at, number, f"completed {completed} of {told}"))
                session = None
            else:
                session = (completed, total, at, number, kind)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session is None:
            self.session.clear()
        else:
            self.session.update(session)
            self.handle.registerTimer(session[2] // 1000 + self.silence_ms)
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [self._silent(key[0], self.session.get())] if self.session.exists() else []
        self.session.clear()
        yield self._frame(found)

    @staticmethod
    def _frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["worker", "failure", "at_us", "event_id", "detail"])

    def close(self) -> None:
        pass


def detect_failures(
    stream: DataFrame, worker: str, ts: str, kind: str, amount: str, order: str, silence: str, out: str, state: str,
    delay: str = "2 hours",
) -> DataFrame:
    """Run what is new of an event stream and return all failures: (worker, failure, at, event_id, detail).

    One line per fault: an ``error`` event, an ``unknown event`` (a null kind is one), a ``missing total`` (``done``
    before the total of ``ready`` is reached exactly, or without one) and ``silent`` (an open session without an
    event for ``silence``, told at its last event).  Events of one worker go by time and then ``order``; a null
    amount adds nothing.  Events later than ``delay`` behind the newest are dropped, as the watermark says, and
    the end of the stream counts as heard up to the watermark.  Rows without a worker or a time are left out.
    """
    spark = stream.sparkSession
    events = stream.withWatermark(ts, delay).where(F.col(worker).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(worker).cast("string").alias("worker"), F.col(ts).alias("at"), F.unix_micros(ts).alias("at_us"),
        F.col(order).cast("long").alias("event_id"), F.coalesce(F.col(kind), F.lit("null")).alias("kind"),
        F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("amount"), F.col(amount).isNotNull().alias("has_amount"),
    )
    millis = spark.range(1).select(F.expr(f"INTERVAL '{silence}'").alias("i")).select(
        (F.unix_micros(F.lit(0).cast("timestamp") + F.col("i")) / 1000).cast("long")
    ).first()[0]
    found = events.groupBy("worker").transformWithStateInPandas(WorkerWatch(millis), FAILURES, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed timers live in this store only
    try:
        told = run_append(found, out, state)
    finally:
        spark.conf.set(_PROVIDER, before)
    return told.select("worker", "failure", F.timestamp_micros("at_us").alias("at"), "event_id", "detail")
