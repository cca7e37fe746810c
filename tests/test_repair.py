"""Fractions, proposals for measures, and the gates of repair candidates, against plain versions."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from neumatic.functions import rational as q
from neumatic.operators import repair


def frac(x):
    return None if x is None else (x.numerator, x.denominator)


def test_fractions(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 50), rng.choice([-12, -3, 1, 2, 7, 48]), rng.randint(-10**9, 10**9), rng.choice([1, 5, 96, -10**6])) for _ in range(300)] + [(0, 5, 0, 1), (3, 0, 1, 1)]
    a, b = q.fraction(F.col("a"), F.col("b")), q.fraction(F.col("c"), F.col("d"))
    out = spark.createDataFrame(rows, "a long, b long, c long, d long").select("*", a.alias("x"), q.add(a, b).alias("sum"), q.minus(a, b).alias("less"), q.times(a, b).alias("times"), q.compare(a, b).alias("cmp"), q.total(F.array(a, b, a)).alias("total"))
    for r in out.collect():
        if not r["b"]:
            assert r["x"] is None and r["sum"] is None
            continue
        x, y = Fraction(r["a"], r["b"]), Fraction(r["c"], r["d"])
        assert [tuple(r[k]) for k in ("x", "sum", "less", "times", "total")] == [frac(v) for v in (x, x + y, x - y, x * y, x + y + x)]
        assert r["cmp"] == (x > y) - (x < y)


ALLOWED = [Fraction(*p) for p in repair.ALLOWED]
near = lambda v: min(ALLOWED, key=lambda a: abs(a - v)) if v > 0 else ALLOWED[0]


def plain(events, expected):
    if expected is None or any(k != "note" for _, k, _, _ in events):
        return {}
    out, main = {}, []
    for i, (seq, _, chord, v) in enumerate(events):
        ghost = v <= Fraction(1, 1000)
        new = near(v) if abs(near(v) - v) > Fraction(1, 20) else v
        out[seq] = ["drop" if ghost else "keep" if new == v else "quantise", v, new]
        if not ghost and not (chord and i):
            main.append(seq)
    total = sum((out[s][2] for s in main), Fraction(0))
    trim = bool(main) and total > expected + Fraction(1, 100)
    if trim:
        last = out[main[-1]]
        last[2] = near(max(Fraction(1, 8), last[2] - (total - expected)))
    lack = expected - sum((out[s][2] for s in main), Fraction(0))
    for seq in out:
        mine = [s for s in main if s <= seq]
        if mine:
            out[seq][2] = out[mine[-1]][2]
        if out[seq][0] != "drop":
            out[seq][0] = "keep" if out[seq][1] == out[seq][2] else "trim" if trim and mine and mine[-1] == main[-1] else "quantise"
    fits = lack == 0
    if lack > Fraction(1, 100) and lack < expected:
        out[max(out) + 1] = ["append", None, near(lack)]
        fits = lack == near(lack)
    return {s: (a, None if a == "drop" else frac(n), fits) for s, (a, _, n) in out.items()}


def test_proposals_equal_the_rule_and_need_consent(spark):
    rng = random.Random(4)
    measures, events = [], []
    for k in range(300):
        expected = rng.choice([Fraction(4), Fraction(3), Fraction(7, 2), None])
        measures.append((k, frac(expected)))
        events.append([(s, "backup" if rng.random() < 0.02 else "note", rng.random() < 0.2, rng.choice([Fraction(0), Fraction(1, 3), Fraction(2, 3), Fraction(1), Fraction(1), Fraction(1, 2), Fraction(2), Fraction(11, 10), Fraction(1, 2000), Fraction(21, 20)])) for s in range(1, rng.randint(2, 8))])
    rows = [(k, *e[:3], frac(e[3]), False) for k, es in enumerate(events) for e in es]
    kind = "struct<num:bigint,den:bigint>"
    frame = spark.createDataFrame(rows, f"measure_key long, seq long, kind string, is_chord boolean, length {kind}, is_rest boolean")
    asked = spark.createDataFrame(measures, f"measure_key long, expected {kind}")
    proposed = repair.proposals(frame, asked)
    got = {}
    for r in proposed.collect():
        got.setdefault(r["measure_key"], {})[r["seq"]] = (r["action"], r["length"] and tuple(r["length"]), r["fits"])
    expected = {k: plain(es, m[1] and Fraction(*m[1])) for k, (es, m) in enumerate(zip(events, measures))}
    assert got == {k: p for k, p in expected.items() if p}
    assert {a for p in got.values() for a, _, _ in p.values()} == {"keep", "drop", "quantise", "trim", "append"}
    assert repair.applied(frame, proposed) is frame
    done = repair.applied(frame, proposed, opt_in=True).where("not is_chord or seq = 1")
    sums = {r["measure_key"]: Fraction(*r["t"]) for r in done.where("kind = 'note'").groupBy("measure_key").agg(q.total(F.collect_list("length")).alias("t")).collect()}
    for k, p in got.items():
        if all(f for _, _, f in p.values()) and not any(p.get(1, ("",))[0] == "drop" for _ in [0]):
            assert sums[k] == Fraction(*measures[k][1])


def test_tuplet_gates_and_image_proposals(spark):
    # three filled quarters under a bracket and a half note, in 4/4 with two quarters left
    pitch = lambda at: ("CDEFGAB"[at % 7], at // 7)
    notes = lambda ats, ticks, alter=0: [(i + 1, *pitch(a), alter, False, True, t) for i, (a, t) in enumerate(zip(ats, ticks))]
    given = {
        1: (notes([30, 31, 32, 33], [6, 6, 6, 12]), [30, 31, 32, 33], [False, False, False, True], (4, 1), [(10.0, 30.0)]),
        2: (notes([30, 31, 32, 33], [6, 6, 6, 12]), [30, 31, 32, 34], [False, False, False, True], (4, 1), [(10.0, 30.0)]),  # another pitch
        3: (notes([30, 31, 32], [6, 6, 6]), [30, 31, 32], [False, False, False], (3, 1), [(10.0, 30.0)]),  # three quarters left
        4: (notes([30, 31, 32, 33], [6, 6, 6, 12]), [30, 31, 32], [False, False, False], (4, 1), [(10.0, 30.0)]),  # a head too few
        5: (notes([30, 31, 32, 33], [6, 6, 6, 12]), [30, 31, 32, 33], [False, False, False, True], (4, 1), []),  # no bracket
        6: (notes([30, 31, 32, 33], [4, 4, 4, 8]), [30, 31, 32, 33], [False, False, False, True], (4, 1), [(10.0, 30.0)]),  # no whole ticks
        7: (notes([33, 31, 32, 30], [6, 6, 6, 12], 0), [33, 31, 32, 30], [False, False, False, True], (3, 1), [(10.0, 30.0)]),  # one quarter left
    }
    divisions = {6: 4}
    candidates = [(k, *n) for k, g in given.items() for n in g[0]]
    heads = [(k, 10.0 * (i + 1), 100.0 - 5 * (a - 30), h, i) for k, g in given.items() for i, (a, h) in enumerate(zip(g[1], g[2]))]
    evidence = [(k, divisions.get(k, 6), g[3], 0, 100.0, 10.0 if k else 0.0, g[4]) for k, g in given.items()]
    heads = [(k, x + (20 if i == 3 else 0), y, h, i) for k, x, y, h, i in heads]
    kind = "struct<num:bigint,den:bigint>"
    h = spark.createDataFrame(heads, "measure_key long, x double, y double, hollow boolean, tie int")
    e = spark.createDataFrame(evidence, f"measure_key long, divisions long, expected {kind}, fifths int, bottom double, interline double, spans array<struct<x1:double,x2:double>>")
    c = spark.createDataFrame(candidates, "measure_key long, seq long, step string, octave long, alter_by int, is_chord boolean, is_pitched boolean, ticks long")
    out = {r["measure_key"]: r for r in repair.tuplet_gates(c, h, e).collect()}
    assert {k for k, r in out.items() if r["agrees"]} == {1}
    assert [tuple(a) for a in out[1]["adjusted"]] == [(1, 4), (2, 4), (3, 4), (4, 12)]
    assert not out[2]["pitches"] and tuple(out[3]["remaining"]) == (3, 1) and not out[4]["as_many"] and not out[5]["one_bracket"] and not out[6]["exact"]
    made = {}
    for r in repair.image_proposals(h, e).orderBy("tie").collect():
        made.setdefault(r["measure_key"], []).append((r["at"], tuple(r["quarters"])))
    assert made[1] == [(30, (2, 3)), (31, (2, 3)), (32, (2, 3)), (33, (2, 1))] and made[7][0] == (33, (1, 3))
    assert set(made) == {1, 2, 6, 7}


def test_verified_needs_every_gate(spark):
    good = {"heads": 3, "verses": [3, 3], "ticks": [2, 2, 4], "own": 2, "now": 4, "expected": (4, 1), "made": "h"}
    cases = {0: {}, 1: {"heads": 2}, 2: {"verses": [3, 2]}, 3: {"verses": []}, 4: {"expected": (3, 1)}, 5: {"own": 3, "now": 4, "expected": (8, 3)}, 6: {"made": "old"}, 7: {"expected": None}}
    cases = {k: good | v for k, v in cases.items()}
    kind = "struct<num:bigint,den:bigint>"
    c = spark.createDataFrame([(k, i, False, t, v["own"], v["made"]) for k, v in cases.items() for i, t in enumerate(v["ticks"])], "measure_key long, seq long, is_chord boolean, ticks long, divisions long, xml_sha256 string")
    h = spark.createDataFrame([(k, v["heads"]) for k, v in cases.items()], "measure_key long, n long")
    w = spark.createDataFrame([(k, i, n) for k, v in cases.items() for i, n in enumerate(v["verses"])], "measure_key long, verse int, n long")
    m = spark.createDataFrame([(k, v["now"], v["expected"], "h") for k, v in cases.items()], f"measure_key long, divisions long, expected {kind}, xml_sha256 string")
    out = {r["measure_key"]: r for r in repair.verified(c, h, w, m).collect()}
    assert {k for k, r in out.items() if r["verified"]} == {0}
    failed = {k: [g for g in ("heads_match", "verses_match", "beats_match", "exact", "current") if not r[g]] for k, r in out.items()}
    assert failed == {0: [], 1: ["heads_match"], 2: ["verses_match"], 3: ["verses_match"], 4: ["beats_match"], 5: ["exact"], 6: ["current"], 7: ["beats_match"]}
