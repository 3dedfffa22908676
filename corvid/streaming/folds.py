"""Rules that depend on the order of a key's events: one step function serves a batch and a stream.

A step takes (state, time in ms, units) and gives (state, verdict); the state is a tuple of two longs, or None at first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[tuple | None, int, int], tuple[tuple, bool]]
VERDICT = "key string, event_id long, accepted boolean"


def replay_guard(hold_ms: int) -> Step:
    """Accepts a key unless it accepted it under ``hold_ms`` ago; a refused repeat doesn't extend the hold."""

    def step(state, at, units):
        ok = state is None or at - state[0] >= hold_ms
        return ((at, 0) if ok else state), ok

    return step


def tumbling_quota(limit: int, window_ms: int) -> Step:
    """Accepts units while the window's sum stays within ``limit``; refused units don't count."""

    def step(state, at, units):
        start = at // window_ms * window_ms
        used = state[1] if state is not None and state[0] == start else 0
        ok = used + units <= limit
        return (start, used + units if ok else used), ok

    return step


def anchored_quota(limit: int, window_ms: int) -> Step:
    """The same, but a window opens at the first event after the last one's end."""

    def step(state, at, units):
        start, used = state if state is not None and at - state[0] < window_ms else (at, 0)
        ok = used + units <= limit
        return (start, used + units if ok else used), ok

    return step


def session(idle_ms: int, cap_ms: int) -> Step:
    """True where a session begins: after ``idle_ms`` without events, or ``cap_ms`` after its start. State: start, last event."""

    def step(state, at, units):
        new = state is None or at - state[1] >= idle_ms or at - state[0] >= cap_ms
        return ((at, at) if new else (state[0], at)), new

    return step


def packing(limit: int, gap: int = 2) -> Step:
    """True where a piece of ``units`` opens a new pack, as it no longer fits in ``limit`` after ``gap``. The time is the piece's place."""

    def step(state, at, units):
        size = state[1] if state is not None else 0
        new = size + units + gap > limit
        return (at, units if new else size + units + gap), new

    return step


def batch(events: DataFrame, step: Step) -> DataFrame:
    """VERDICT rows of events(key, event_id, at, units): keys are dealt to tasks and read in time order, a row at a time, so
    a key's events needn't fit in memory."""
    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", F.col("at").cast("long").alias("at"), F.col("units").cast("long").alias("units"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            out = []
            for k, at, units in zip(*(b.column(c).to_pylist() for c in ("key", "at", "units")), strict=True):
                if k != key:
                    key, state = k, None
                state, ok = step(state, at, units)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), pa.array(out, pa.bool_())], names=["key", "event_id", "accepted"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, VERDICT)


def stream(events: DataFrame, step: Step, hold_ms: int, late: str = "0 seconds") -> DataFrame:
    """The same over a stream; a key's events of one micro-batch are put in time order.

    A key's state goes once the watermark, ``late`` behind the newest event of all, is ``hold_ms`` past the key's newest
    event. With at least the step's own hold, window or idle time (a session's cap needs none), a state that old counts as
    none, so no verdict changes. Rows that the watermark has passed get no verdict.
    """

    def run(key, frames, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        *held, newest = state.get if state.exists else (None, 0)
        held = tuple(held) if state.exists else None
        # A key has few rows in a micro-batch, where sorting frames costs more than all else.
        parts = [[f[c].to_numpy() for c in ("at", "event_id", "units")] for f in frames]
        ats, ids, units = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ats))
        out = []
        for at, n in zip(ats[order].tolist(), units[order].tolist(), strict=True):
            held, ok = step(held, int(at), int(n))
            out.append(ok)
        newest = max(newest, int(ats.max()))
        state.update((int(held[0]), int(held[1]), newest))
        state.setTimeoutTimestamp(max(newest + hold_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": np.full(len(out), key[0], object), "event_id": ids[order], "accepted": out})

    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", F.col("at").cast("long").alias("at"), F.col("units").cast("long").alias("units"))
    timed = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, VERDICT, "a long, b long, newest long", "append", "EventTimeTimeout")


def usage(events: DataFrame, seconds: int, watermark: str | None = None) -> DataFrame:
    """Units of each key and tumbling window; a stream takes a watermark."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.sum("units").alias("units")).select("key", F.unix_timestamp("w.start").alias("start"), "units")
