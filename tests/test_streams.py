"""Streams give what a fold over all events gives, whatever the order, repeats and restarts of deliveries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from neumatic.operators.review import TRANSITIONS
from neumatic.streaming import keyed, review

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


@pytest.fixture(scope="module")
def session(spark):
    keyed.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(session, tmp_path, schema, batches, make):
    """Rows of make(stream), one restart from its checkpoint for each batch of rows."""
    source, got = tmp_path / "source", []
    source.mkdir()
    for i, rows in enumerate(batches):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = make(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        mode = "update" if make in (keyed.confirmations, review.seconds_per_window) else "append"
        q = out.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return got


def shuffled(rows, rng, n=3):
    """All rows in a random order, some twice, in n batches; the last batch is later than all."""
    rows = [*rows, *rng.sample(rows, len(rows) // 4)]
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_runs_are_admitted_as_in_order(session, tmp_path):
    rng = random.Random(1)
    events, queued = [], []
    for i in range(60):
        score, engine = rng.randint(1, 3), rng.choice("ab")
        finish = queued and rng.random() < 0.4
        action = f"finish:{rng.choice(queued)}" if finish else "queue"
        if not finish:
            queued.append(f"e{i:03d}")
        events.append((score, engine, at(i // 2), f"e{i:03d}", action))
    want, active = {}, {}
    for score, engine, _, run, action in sorted(events, key=lambda e: (e[2], e[3])):
        if action == "queue":
            had = active.get((score, engine))
            active[score, engine] = had or run
            want[run] = (had or run, had is None)
        elif active.get((score, engine)) == action[7:]:
            active[score, engine] = None
    batches = shuffled(events, rng) + [[(99, "z", at(9999), "end", "queue")]]
    got = streamed(session, tmp_path, "score_id long, engine string, at timestamp, event_id string, action string", batches, keyed.admitted_runs)
    assert {r["event_id"]: (r["active"], r["admitted"]) for r in got} == want and len(got) == len(want)


def test_statuses_change_as_in_order(session, tmp_path):
    rng = random.Random(2)
    names = sorted({s for t in TRANSITIONS for s in t})
    events = [(rng.randint(1, 4), at(i), f"e{i:03d}", rng.choice(names)) for i in range(80)]
    want, now = {}, {}
    for score, _, event, status in events:
        prior = now.get(score)
        allowed = prior is None or prior == status or (prior, status) in TRANSITIONS
        now[score] = status if allowed else prior
        want[event] = (prior, status, allowed)
    got = streamed(session, tmp_path, "score_id long, at timestamp, event_id string, status string", shuffled(events, rng) + [[(99, at(9999), "end", "READY")]], keyed.status_changes)
    assert {r["event_id"]: (r["prior"], r["status"], r["allowed"]) for r in got} == want and len(got) == len(want)


def test_silent_engines_go_offline(session, tmp_path):
    beats = [[("a", at(0)), ("b", at(5)), ("a", at(20))], [("a", at(45)), ("a", at(45)), ("b", at(30))], [("c", at(100))], [("a", at(120))], [("z", at(999))], [("z", at(1000))]]
    got = streamed(session, tmp_path, "engine string, at timestamp", beats, keyed.engine_changes)
    said = sorted((r["engine"], (r["at"] - T0).total_seconds(), r["online"]) for r in got if r["engine"] != "z")
    assert said == [("a", 0, True), ("a", 75, False), ("a", 120, True), ("a", 150, False), ("b", 5, True), ("b", 60, False), ("c", 100, True), ("c", 130, False)]


def test_confirmations_can_be_taken_back(session, tmp_path):
    rng = random.Random(3)
    events = [("x", "a", "b", rng.choice(["_", "p _"]), f"e{rng.randint(0, 15)}", rng.random() < 0.25) for _ in range(60)]
    got = streamed(session, tmp_path, "book string, before string, after string, context string, event string, retract boolean", shuffled(events, rng), keyed.confirmations)
    last = {}
    for r in got:
        last[r["context"]] = r["confirmations"]
    for context in ("_", "p _"):
        gone = {e[4] for e in events if e[3] == context and e[5]}
        assert last[context] == len({e[4] for e in events if e[3] == context} - gone)


def test_each_confirmation_once_and_seconds_by_window(session, tmp_path):
    rows = [("x", "a", "b", "_", f"e{i % 7}", at(i)) for i in range(20)]
    (tmp_path / "one").mkdir()
    once = streamed(session, tmp_path / "one", "book string, before string, after string, context string, event string, at timestamp", [rows[:9], rows[9:]], review.confirmed_once)
    assert sorted(r["event"] for r in once) == [f"e{i}" for i in range(7)]
    log = [(1, at(600 * i), float(i - 1)) for i in range(12)]
    (tmp_path / "two").mkdir()
    sums = {}
    for r in streamed(session, tmp_path / "two", "score_id long, at timestamp, seconds double", [log[:5], log[5:]], review.seconds_per_window):
        sums[r["start"]] = r["seconds"]
    assert sums == {at(0): 0.0 + 0 + 1 + 2 + 3 + 4, at(3600): 5.0 + 6 + 7 + 8 + 9 + 10}


def test_landed_artifacts_not_yet_done(session):
    new = session.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, source_sha256 string")
    done = session.createDataFrame([("h1", "v2"), ("h2", "v1")], "source_sha256 string, version string")
    assert sorted(r["path"] for r in review.landed(new, done, "v2").collect()) == ["b", "c"]
    assert review.landed(new, done.where(F.lit(False)), "v2").count() == 3
