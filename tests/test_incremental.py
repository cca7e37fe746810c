"""A table kept up to date equals one built anew, and untouched buckets are not written."""

import random

from pyspark.sql import functions as F

from neumatic.operators import incremental


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_only_changed_scores_are_built(spark, tmp_path):
    rng = random.Random(5)
    now = {s: [rng.randint(0, 9) for _ in range(rng.randint(0, 6))] for s in range(60)}
    built = []

    def build(events):
        built.append({r["score_id"] for r in events.select("score_id").distinct().collect()})
        return events.where("v <> 9").groupBy("score_id", "seq").agg(F.max("v").alias("top"))

    def frame():
        rows = [(s, i, v) for s, vs in now.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "score_id long, seq int, v int").repartition(3)

    path = tmp_path / "table"

    def step(version="1"):
        done = {r["score_id"]: r["action"] for r in incremental.update(spark, str(path), frame(), build, version=version, buckets=16).collect()}
        got = sorted(map(tuple, incremental.rows_of(spark, str(path), "seq").select("score_id", "seq", "top").collect()))
        assert got == sorted((s, i, v) for s, vs in now.items() for i, v in enumerate(vs) if v != 9)
        return done

    assert set(step().values()) == {"build"}
    old = files_of(path)
    assert step() == {} and files_of(path) == old
    alive = [s for s in now if now[s]]
    now[alive[0]] = [*now[alive[0]], 3]
    now[alive[1]] = now[alive[1]][::-1] + [1]
    now[alive[2]] = []
    now[99] = [4, 4]
    assert step() == {alive[0]: "rebuild", alive[1]: "rebuild", alive[2]: "remove", 99: "build"}
    assert built[-1] == {alive[0], alive[1], 99}
    buckets = {r["b"] for r in spark.createDataFrame([(s,) for s in (*alive[:3], 99)], "score_id long").select(incremental.bucket_of(buckets=16).alias("b")).collect()}
    changed = {f for f, t in files_of(path).items() if old.get(f) != t}
    assert {int(f.split("/")[0].split("=")[1]) for f in changed} <= buckets
    untouched = {f: t for f, t in old.items() if int(f.split("/")[0].split("=")[1]) not in buckets}
    assert untouched and all(files_of(path)[f] == t for f, t in untouched.items())
    assert set(step("2").values()) == {"rebuild"}
    for s in list(now):
        now[s] = []
    assert set(step("2").values()) == {"remove"} and step("2") == {}
