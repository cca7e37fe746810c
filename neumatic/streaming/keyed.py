"""State by key over event streams: engines that fall silent, run admission, the status machine, retractable confirmations.

These need the RocksDB state store; use_rocksdb() sets it for a session.
Deliveries may repeat and come in any order. Ordered processors hold an event
until the watermark has passed it, so what they say is what a fold in order of
time says; an event later than the watermark is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.review import TRANSITIONS

DAY_MS = 24 * 3600 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Hands the events of a key to step() in order of (at, event_id), each once, when the watermark has passed them.

    Rows in: at (timestamp), event_id, and the columns PAYLOAD; rows out: the
    key's columns and those of OUT. step(state, event) changes the state, a dict
    that JSON can hold, and returns the values of OUT, or None for no row.
    """

    KEYS: list[str] = []
    PAYLOAD: list[str] = []
    OUT: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "at long, event_id string", "payload string")
        self.held = handle.getValueState("held", "state string")

    def step(self, state: dict, event: dict) -> tuple | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            times = frame["at"].astype("datetime64[us]").astype("int64")
            for i, at in enumerate(times):
                row = frame.iloc[i]
                place = (int(at), str(row["event_id"]))
                due = int(at) // 1000 + 1
                if due <= passed or self.buffer.containsKey(place):
                    continue
                self.buffer.updateValue(place, (json.dumps({c: None if pd.isna(row[c]) else row[c].item() if hasattr(row[c], "item") else row[c] for c in self.PAYLOAD}),))
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(place for place in map(tuple, self.buffer.keys()) if place[0] // 1000 + 1 <= passed)
        if not due:
            return iter([])
        state = json.loads(self.held.get()[0]) if self.held.exists() else {}
        out = []
        for place in due:
            event = json.loads(self.buffer.getValue(place)[0]) | {"event_id": place[1]}
            said = self.step(state, event)
            if said is not None:
                out.append((*key, *said))
            self.buffer.removeKey(place)
        self.held.update((json.dumps(state),))
        return iter([pd.DataFrame(out, columns=[*self.KEYS, *self.OUT])] if out else [])


class Admission(Ordered):
    """A run is admitted unless one of its engine is active for the score; then the active one stands for it."""

    KEYS, PAYLOAD, OUT = ["score_id", "engine"], ["action"], ["event_id", "active", "admitted"]

    def step(self, state, event):
        run, active = event["event_id"], state.get("active")
        if event["action"].startswith("finish:"):
            if event["action"].removeprefix("finish:") == active:
                state["active"] = None
            return None
        if active is None:
            state["active"] = run
        return run, state["active"], active is None


class StatusMachine(Ordered):
    """Each change of a score's status, and whether it is one of the listed transitions; others leave the status as it is."""

    KEYS, PAYLOAD, OUT = ["score_id"], ["status"], ["event_id", "prior", "status", "allowed"]

    def step(self, state, event):
        prior, new = state.get("status"), event["status"]
        allowed = prior is None or prior == new or (prior, new) in TRANSITIONS
        if allowed:
            state["status"] = new
        return event["event_id"], prior, new, allowed


class Liveness(StatefulProcessor):
    """A row when an engine comes online, and one when it has been silent for `silence_ms`, at the time when that is so."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, online boolean")

    def handleInputRows(self, key, rows, timerValues):
        beats = sorted({int(at) for frame in rows for at in frame["at"].astype("datetime64[ms]").astype("int64")})
        had, online = self.last.get() if self.last.exists() else (None, False)
        out = []
        for at in beats:
            if had is not None and at <= had:
                continue
            if online and at - had >= self.silence_ms:
                self.handle.deleteTimer(had + self.silence_ms)
                out.append((key[0], pd.Timestamp(had + self.silence_ms, unit="ms"), False))
                online = False
            elif online:
                self.handle.deleteTimer(had + self.silence_ms)
            if not online:
                out.append((key[0], pd.Timestamp(at, unit="ms"), True))
            had, online = at, True
            self.handle.registerTimer(at + self.silence_ms)
        if had is not None:
            self.last.update((had, online))
        return iter([pd.DataFrame(out, columns=["engine", "at", "online"])] if out else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        had, online = self.last.get()
        if not online or expiredTimerInfo.getExpiryTimeInMs() < had + self.silence_ms:
            return iter([])
        self.last.update((had, False))
        return iter([pd.DataFrame([(key[0], pd.Timestamp(had + self.silence_ms, unit="ms"), False)], columns=["engine", "at", "online"])])


class Confirmations(StatefulProcessor):
    """Events that confirm a correction, each counted once; a retracted event counts never, also if it comes after its retraction."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "event string", "retracted boolean", self.ttl_ms)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        before = now = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            for event, retract in zip(frame["event"], frame["retract"]):
                known = self.events.getValue((event,))[0] if self.events.containsKey((event,)) else None
                if retract and known is not True:
                    now -= known is False
                    self.events.updateValue((event,), (True,))
                elif not retract and known is None:
                    now += 1
                    self.events.updateValue((event,), (False,))
        self.count.update((now,))
        return iter([pd.DataFrame([(*key, now)], columns=["book", "before", "after", "context", "confirmations"])] if now != before else [])


def _ordered(events: DataFrame, processor: Ordered, schema: str, late: str) -> DataFrame:
    rows = events.withWatermark("at", late).select(*processor.KEYS, "at", F.col("event_id").cast("string").alias("event_id"), *processor.PAYLOAD)
    return rows.groupBy(*processor.KEYS).transformWithStateInPandas(processor, schema, "append", "EventTime")


def admitted_runs(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """score_id, engine, event_id, active, admitted of each request (score_id, engine, at, event_id, action: "queue" or "finish:<event_id>")."""
    return _ordered(requests, Admission(), "score_id long, engine string, event_id string, active string, admitted boolean", late)


def status_changes(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """score_id, event_id, prior, status, allowed of each change (score_id, at, event_id, status)."""
    return _ordered(changes, StatusMachine(), "score_id long, event_id string, prior string, status string, allowed boolean", late)


def engine_changes(beats: DataFrame, silence: int = 30, late: str = "10 seconds") -> DataFrame:
    """engine, at, online: when engines come and go, from heartbeats (engine, at); offline after `silence` seconds."""
    rows = beats.withWatermark("at", late).select("engine", "at")
    return rows.groupBy("engine").transformWithStateInPandas(Liveness(silence * 1000), "engine string, at timestamp_ntz, online boolean", "append", "EventTime")


def confirmations(corrections: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """The confirmations of each (book, before, after, context) that change, from events (those, event, retract).

    With `ttl_days`, events are remembered that long (by the clock, so such a
    query has to be stopped; a trigger of what is available now does not end).
    """
    keys = ["book", "before", "after", "context"]
    processor, mode = (Confirmations(None), "None") if ttl_days is None else (Confirmations(ttl_days * DAY_MS), "ProcessingTime")
    rows = corrections.select(*keys, "event", "retract")
    return rows.groupBy(*keys).transformWithStateInPandas(processor, "book string, before string, after string, context string, confirmations long", "update", mode)
