"""The life cycle of files as a stream with state: allowed transitions, refused events, and files that are stuck.

A file's state lives in the state store, so it outlasts the job.  What is under way for too long fails, either when its next event shows
that, or by a timer when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State after state; the empty one is that of a file not seen before.  A completed or failed file may be taken up again.
ALLOWED = {
    "": ("pending", "processing"),
    "pending": ("processing", "failed"),
    "processing": ("extracting", "failed"),
    "extracting": ("completed", "failed"),
    "completed": ("processing",),
    "failed": ("pending", "processing"),
}
UNDER_WAY = ("processing", "extracting")
TIMED_OUT, NOT_ALLOWED, LATE = "timed out", "not allowed", "late"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tracker(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, since, seen = self.now.get() if self.now.exists() else ("", 0, -(2**62))
        events = pd.concat(list(rows)).sort_values(["at_ms", "n"], kind="stable")  # of one file in one micro-batch
        out = []
        for at, n, wanted in events[["at_ms", "n", "state"]].itertuples(index=False):
            if state in UNDER_WAY and at >= since + self.limit_ms:
                out.append((since + self.limit_ms, -1, state, "failed", TIMED_OUT))
                state, since = "failed", since + self.limit_ms
            refused = LATE if at < seen else None if wanted in ALLOWED.get(state, ()) else NOT_ALLOWED
            out.append((at, n, state, wanted, refused))
            seen = max(seen, at)
            if refused is None:
                state, since = wanted, at
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state in UNDER_WAY:
            self.handle.registerTimer(int(since + self.limit_ms))
        self.now.update((state, int(since), int(seen)))
        yield _rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, since, seen = self.now.get()
        if state in UNDER_WAY:
            at = since + self.limit_ms
            self.now.update(("failed", int(at), int(max(seen, at))))
            yield _rows(key, [(at, -1, state, "failed", TIMED_OUT)])

    def close(self) -> None:
        pass


def _rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["at_ms", "n", "before", "state", "note"])
    frame.insert(0, "file", key[0])
    return frame


def transitions(events: DataFrame, limit: float, late: str = "1 hour") -> DataFrame:
    """file, at, n, before, state and note for each event of a stream (file, at timestamp, n long, state): note is null where the file went
    from ``before`` to ``state``, says why an event was refused, or that a file under way for ``limit`` seconds has failed (n is -1).

    A file's events in one micro-batch are taken by time, then n; one older than an event of an earlier micro-batch is refused as
    late.  The watermark follows ``late`` behind the newest event.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    kind = events.schema["file"].dataType.simpleString()
    timed = events.select("file", "at", F.col("n").cast("long").alias("n"), "state", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    out = timed.groupBy("file").transformWithStateInPandas(_Tracker(round(limit * 1000)), f"file {kind}, at_ms long, n long, before string, state string, note string", "Append", "EventTime")
    return out.select("file", F.timestamp_millis("at_ms").alias("at"), "n", "before", "state", "note")


def latest(log: DataFrame) -> DataFrame:
    """file, state, moves, refused, timed_out: from the log of transitions, as a table."""
    moved = F.col("note").isNull() | (F.col("note") == TIMED_OUT)
    # A time-out comes before an event of the same moment.
    last = F.max_by("state", F.when(moved, F.struct("at", "n")))
    return log.groupBy("file").agg(F.coalesce(last, F.lit("")).alias("state"), F.count_if(F.col("note").isNull()).alias("moves"), F.count_if(F.col("note").isin(NOT_ALLOWED, LATE)).alias("refused"), F.count_if(F.col("note") == TIMED_OUT).alias("timed_out"))
