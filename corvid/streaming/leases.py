"""Leases of jobs over time: claims, renewals, completion, and expiry when no renewal comes, in batch and as a stream with timers.

Events are rows (id, event_id, at, worker, action, lease_ms), ``at`` in ms. A 'claim' succeeds where no lease holds: the job
is new, or its lease has expired. A 'renew' or 'complete' succeeds for the worker that holds the lease, also after it has
expired, as long as nobody has claimed the job since. A lease of under 1 ms or null, a null worker, or another action is
refused. A lease that isn't renewed or completed at or before its end expires then. A job is forgotten ``hold_ms`` after it
was completed or has expired. Rows without id or time count for nothing; of equal times the lower event_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row for each event, and one without event_id for each expiry; ``attempts`` counts a job's claims.
OUTCOME = "id string, event_id long, at long, worker string, outcome string, attempts long"
STATE = "worker string, ends long, attempts long, status string"
WAITING = "event_id long, at long, worker string, action string, lease_ms long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lapse(state: tuple | None, now: int, hold_ms: int) -> tuple[tuple | None, list]:
    """What time alone has done to a state (worker, ends, attempts, status) just before ``now``."""
    rows = []
    if state is not None and state[3] == "running" and state[1] < now:
        rows.append((None, state[1], state[0], "expired", state[2]))
        state = (*state[:3], "expired")
    if state is not None and state[3] != "running" and now - state[1] >= hold_ms:
        state = None
    return state, rows


def step(state: tuple | None, event: tuple, hold_ms: int) -> tuple[tuple | None, list]:
    """The state after an event (event_id, at, worker, action, lease_ms), and the rows (event_id, at, worker, outcome, attempts) it gives."""
    event_id, at, worker, action, lease = event
    state, rows = lapse(state, at, hold_ms)
    attempts = state[2] if state else 0
    free = state is None or state[3] == "expired"
    own = state is not None and state[3] != "complete" and state[0] == worker
    outcome = "refused"
    if worker is not None and action == "complete" and own:
        state, outcome = (worker, at, attempts, "complete"), "completed"
    elif worker is not None and lease is not None and lease >= 1:
        if action == "claim" and free:
            attempts += 1
            state, outcome = (worker, at + lease, attempts, "running"), "claimed"
        elif action == "renew" and own:
            state, outcome = (worker, at + lease, attempts, "running"), "renewed"
    return state, [*rows, (event_id, at, worker, outcome, attempts)]


def _events(events: DataFrame) -> DataFrame:
    kinds = {"id": "string", "event_id": "long", "at": "long", "worker": "string", "action": "string", "lease_ms": "long"}
    return events.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).where("id is not null and at is not null")


def batch(events: DataFrame, until: int, hold_ms: int) -> DataFrame:
    """OUTCOME rows of events at or before ``until``, and of leases that have expired by then. Keys are dealt to tasks and
    read in time order, a row at a time, so a key's events needn't fit in memory."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["id", "event_id", "at", "worker", "outcome", "attempts"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        table = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        key, state = None, None
        for b in batches:
            out = []
            for k, *event in zip(*(b.column(c).to_pylist() for c in ("id", "event_id", "at", "worker", "action", "lease_ms")), strict=True):
                if k != key:
                    out += [(key, *r) for r in lapse(state, until + 1, hold_ms)[1]]
                    key, state = k, None
                state, rows = step(state, tuple(event), hold_ms)
                out += [(k, *r) for r in rows]
            yield table(out)
        yield table([(key, *r) for r in lapse(state, until + 1, hold_ms)[1]])

    rows = _events(events).where(F.col("at") <= until)
    return rows.repartition("id").sortWithinPartitions("id", "at", F.asc_nulls_first("event_id")).mapInArrow(run, OUTCOME)


class _Leases(StatefulProcessor):
    """Events wait in state until the watermark has passed them, so they count in time order however they arrive.

    A job has a timer for the first event that waits, kept as ``first``, and one for its lease; when one is due all events
    that are due are read. So a job wakes as often as the watermark moves past something of it, not for each event.
    """

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", STATE)
        self.waiting = handle.getListState("waiting", WAITING)
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        events = []
        for frame in rows:
            columns = [[None if v is None or v != v else k(v) for v in frame[c].tolist()] for c, k in (("event_id", int), ("at", int), ("worker", str), ("action", str), ("lease_ms", int))]
            events += zip(*columns, strict=True)
        if events:
            self.waiting.appendList(events)
            self._wait(min(e[1] for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in held if e[1] <= passed), key=lambda e: (e[1], e[0] is not None, e[0] or 0))
        before = state = tuple(self.lease.get()) if self.lease.exists() else None
        out = []
        for event in due:
            state, rows = step(state, event, self.hold_ms)
            out += rows
        state, rows = lapse(state, passed + 1, self.hold_ms)
        out += rows
        if due:
            left = [e for e in held if e[1] > passed]
            if left:
                self.waiting.put(left)
                self.first.clear()
                self._wait(min(e[1] for e in left))
            else:
                self.waiting.clear()
                self.first.clear()
        if state != before:
            if before is not None and self._wakes(before) > passed:
                self.handle.deleteTimer(self._wakes(before))
                if self.first.exists() and self.first.get()[0] == self._wakes(before):
                    self.handle.registerTimer(self._wakes(before))
            if state is None:
                self.lease.clear()
            else:
                self.lease.update(state)
                self.handle.registerTimer(max(self._wakes(state), passed + 1))
        names = [c.split()[0] for c in OUTCOME.split(", ")]
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=names, dtype=object)

    def _wait(self, at: int) -> None:
        """Sees that the job wakes for an event at ``at``; a later timer that stands is no more than a look at the state."""
        if not self.first.exists() or at < self.first.get()[0]:
            self.first.update((at,))
            self.handle.registerTimer(at)

    def _wakes(self, state: tuple) -> int:
        """When time alone next changes a state."""
        return state[1] if state[3] == "running" else state[1] + self.hold_ms

    def close(self) -> None:
        pass


def stream(events: DataFrame, hold_ms: int, late: str) -> DataFrame:
    """The same over a stream, up to its watermark, ``late`` behind the newest event of all: rows come once the watermark
    has passed them, and an expiry by a timer once it has passed the lease's end. Rows that the watermark has passed when
    they arrive count for nothing. The session's state store must be RocksDB (``ROCKSDB``); ``at`` is of a job's clock, in ms."""
    timed = _events(events).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return timed.groupBy("id").transformWithStateInPandas(_Leases(hold_ms), OUTCOME, "append", "eventTime")
