"""Column functions and operators on small hand-made cases."""

import math
import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from neumatic.functions import boxes, music, text
from neumatic.operators import joins, review, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("symbol", ["Em", "Am7", "F#m", "G/B", "Bb", "Cmaj7", "D7#5", "Bdim", "Csus4"])
def test_chords_accepted(spark, symbol):
    assert one(spark, music.is_chord(F.lit(symbol)))


@pytest.mark.parametrize("symbol", ["ca", "em", "Ba", "F4m", "C?", "C999"])
def test_chords_rejected(spark, symbol):
    assert not one(spark, music.is_chord(F.lit(symbol)))


def test_pitch_and_meter(spark):
    assert one(spark, music.midi_pitch(F.lit("C"), F.lit(4), F.lit(0))) == 60
    assert one(spark, music.expected_beats(F.lit("3+2"), F.lit(8))) == 2.5
    up = one(spark, music.transposed(F.lit("B"), F.lit(4), F.lit(1), 1))
    assert (up["step"], up["alter"], up["octave"]) == ("C", 1, 5)
    assert one(spark, music.transposed_symbol(F.lit("F#m7/C#"), 1)) == "Gm7/D"
    assert one(spark, music.quantised(F.lit(0.6))) == 0.5 and one(spark, music.quantised(F.lit(-1.0))) == 0.25
    assert one(spark, music.staff_position(F.lit(31.0), F.lit(10.0), F.lit(10.0))) == 4


def test_text(spark):
    assert one(spark, text.fold(F.lit("Đường, về!"))) == "duongve"
    assert one(spark, text.tone(F.lit("về"))) == 1 and one(spark, text.tone(F.lit("tôi"))) == 0
    assert one(spark, text.mark_count(F.lit("đường"))) == 3
    assert [one(spark, text.syllabic(F.lit(t)))["syllabic"] for t in ("-a-", "a-", "-a", "a")] == ["middle", "begin", "end", "single"]
    assert one(spark, text.match_case(F.lit("được"), F.lit("DUOC"))) == "ĐƯỢC"
    names = spark.createDataFrame([("page-10",), ("page-2",), ("page-1",)], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in names] == ["page-1", "page-2", "page-10"]


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert abs(one(spark, boxes.iou(b(0, 0, 10, 10), b(5, 0, 15, 10))) - 1 / 3) < 1e-9
    assert one(spark, boxes.overlaps(b(0, 0, 1, 1), b(2, 0, 3, 1), 1.5)) and not one(spark, boxes.overlaps(b(0, 0, 1, 1), b(2, 0, 3, 1)))


def test_interpolation(spark):
    points = spark.createDataFrame([(1, 150.0, 7), (1, 90.0, 8), (1, 300.0, 9)], "m int, x double, id long")
    anchors = spark.createDataFrame([(1, 100.0, 0.0), (1, 200.0, 4.0)], "m int, x double, onset double")
    got = {r["id"]: r["value"] for r in joins.interpolated(points, anchors, ["m"], "x", "onset", "id").collect()}
    assert got == {7: 2.0, 8: 0.0, 9: 4.0}


def test_profile_needs_confirmations(spark):
    rows = [("b", "tho", "the", "_ end", e) for e in ("1:a", "1:b", "1:b")]
    corrections = spark.createDataFrame(rows, "book string, before string, after string, context string, event string")
    words = [(s, b, i, w) for s, b, t in ((1, "b", "at tho end"), (2, "c", "tho end"), (3, "b", "tho tho endless")) for i, w in enumerate(t.split())]
    frame = spark.createDataFrame(words, "score_id long, book string, pos long, text string")
    fixed = lambda c: {(r["score_id"], r["pos"]): r["after"] for r in review.corrected(frame, review.confirmations(c)).collect() if r["after"]}
    assert fixed(corrections) == {}
    more = corrections.unionAll(spark.createDataFrame([("b", "tho", "the", "_ end", "2:c"), *[("b", "tho", "thou", "at _ end", f"{i}:x") for i in range(3)], *[("b", "tho", "no", "_ _", f"{i}:x") for i in range(9)]], corrections.schema))
    assert fixed(more) == {(1, 1): "thou"}


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    a = [(rng.randrange(4), i, rng.randrange(30) * 1.0) for i in range(80)]
    b = [(rng.randrange(5), i, rng.randrange(30) * 1.0) for i in range(40)]
    left, right = spark.createDataFrame(a, "g int, i int, x double"), spark.createDataFrame(b, "g int, j int, y double")
    for within in (None, 2.0):
        got = {tuple(r) for r in joins.nearest(left, right, ["g"], ["g", "i"], "x", "y", ["j"], "j", within).collect()}
        expected = set()
        for g, i, x in a:
            best = min(((abs(x - y), j) for h, j, y in b if h == g), default=None)
            if best and (within is None or best[0] <= within):
                expected.add((g, i, *best))
        assert got == expected
    spans = spark.createDataFrame([(g, j, y, y + j % 5) for g, j, y in b], "g int, j int, low double, high double")
    expected = {(i, j) for g, i, x in a for h, j, y in b if g == h and y <= x < y + j % 5}
    for width in (None, 2.0, 7.0):
        assert {(r["i"], r["j"]) for r in joins.contained(left, spans, ["g"], "x", "low", "high", width).collect()} == expected
        assert {r["i"] for r in joins.contained(left, spans, ["g"], "x", "low", "high", width, "left_semi").collect()} == {i for i, _ in expected}


def test_undo_clears_a_score(spark):
    log = spark.createDataFrame([(1, 1, 5, "accept", 2.0, 1), (2, 1, 6, "skip", 2.0, 2), (3, 1, None, "undo", 1.0, 3), (4, 1, 6, "edit", 1.0, 4), (5, 2, 5, "apply", 9999.0, 5)], "event_id long, score_id long, measure_no long, action string, seconds double, at long")
    assert [tuple(r)[:3] for r in review.folded(log).collect()] == [(1, 6, "open")]


def cheapest(pair, left, right):
    """Matches of the cheapest monotonic alignment by recursion; a match, then leaving out the right row, wins ties."""
    known = {(0, 0): (0.0, {})}
    for i in range(len(left) + 1):
        for j in range(len(right) + 1):
            options = []
            if i and j:
                c, p = known[i - 1, j - 1]
                options.append((c + pair(i - 1, j - 1), p | {i - 1: j - 1}))
            if j:
                options.append((known[i, j - 1][0] + right[j - 1], known[i, j - 1][1]))
            if i:
                options.append((known[i - 1, j][0] + left[i - 1], known[i - 1, j][1]))
            if options:
                known[i, j] = min(options, key=lambda o: o[0])
    return known[len(left), len(right)][1]


@pytest.mark.parametrize("pixel", [False, True])
def test_alignment_equals_recursion(spark, pixel):
    rng = random.Random(4)
    words, notes, expected = [], [], set()
    for s in range(60):
        w = sorted((rng.randrange(80) / 4, i, rng.random(), rng.random() < 0.5, rng.random() < 0.2) for i in range(rng.randint(1, 6)))
        n = sorted((rng.randrange(80) / 4, i, rng.random() < 0.4, rng.random() < 0.3) for i in range(rng.randint(0, 6)))
        words += [(s, i, x, c, k, g) for x, i, c, k, g in w]
        notes += [(s, i, x, a, b) for x, i, a, b in n]
        spread = lambda v: [0.5 if max(v) == min(v) else (x - min(v)) / (max(v) - min(v)) for x in v]
        x, y = [v[0] for v in w], [v[0] for v in n]
        if not pixel and n:
            x = spread(x) if len(x) > 1 or len(y) == 1 else [0.5 if max(y) == min(y) else min(1, max(0, (x[0] - min(y)) / (max(y) - min(y))))]
            y = spread(y)
        cost = lambda i, j: (math.inf if pixel and abs(x[i] - y[j]) > 2.5 else abs(x[i] - y[j])) + (1 - w[i][2]) * 0.35 + (0.5 if pixel and n[j][3] else 0)  # noqa: E731, B023
        place = cheapest(cost, [(3.0 if v[3] else 1.2) if pixel else 1.15 for v in w], [(0.15 if v[2] else 0.6) if pixel else 0.34 for v in n]) if n else {}
        for i, (_, word, conf, _, geometry) in enumerate(w):
            j = place.get(i)
            value = None if j is None else round(conf * math.exp(-(0.8 if pixel else 2.4) * abs(x[i] - y[j])), 6)
            expected.add((s, word, None if j is None else n[j][1], None if value is None else round(value, 4), "no_note_candidate" if j is None else "accepted" if value >= 0.55 and not geometry else "needs_review"))
    w = spark.createDataFrame(words, "s long, word_id long, x double, confidence double, known boolean, geometry_review boolean").repartition(3)
    n = spark.createDataFrame(notes, "s long, note_id long, x double, slurred boolean, continued boolean")
    got = {(r["s"], r["word_id"], r["note_id"], None if r["confidence"] is None else round(r["confidence"], 4), r["status"]) for r in sequences.align_lyrics(w, n, ["s"], pixel=pixel).collect()}
    assert got == expected
    none = sequences.align_lyrics(w, n.limit(0), ["s"], pixel=pixel).collect()
    assert {r["status"] for r in none} == {"no_note_candidate"} and len(none) == len(words)


def test_rows_equal_nearest_median(spark):
    rng = random.Random(9)
    rows, expected = [], set()
    for s in range(40):
        own = [(rng.randrange(60) * 1.0, rng.randrange(100) * 1.0, i, rng.choice((4.0, 10.0, 12.0))) for i in range(rng.randint(1, 30))]
        rows += [(s, i, cx, cy, h) for cy, cx, i, h in own]
        limit, found = 0.6 * statistics.median(max(v[3], 1) for v in own), []
        for cy, cx, i, _ in sorted(own):
            near = min(found, key=lambda r: abs(cy - statistics.median(v[0] for v in r)), default=None)  # noqa: B023
            if near is not None and abs(cy - statistics.median(v[0] for v in near)) <= limit:
                near.append((cy, cx, i))
            else:
                found.append([(cy, cx, i)])
        expected |= {(s, i, r, p) for r, row in enumerate(found) for p, (_, _, i) in enumerate(sorted(row, key=lambda v: (v[1], v[2])))}
    frame = spark.createDataFrame(rows, "s long, box_id long, cx double, cy double, h double").repartition(3)
    assert {tuple(r) for r in sequences.rows_of(frame, ["s"]).collect()} == expected


def test_greedy_matches_equal_plain_loops(spark):
    rng = random.Random(6)
    truth, other, words, notes, pairs, taken = [], [], [], [], set(), set()
    for s in range(50):
        box = lambda: (a := rng.randrange(20), b := rng.randrange(20), a + rng.randint(1, 9), b + rng.randint(1, 9))
        t, p = [(i, *map(float, box())) for i in range(rng.randint(0, 5))], [(i, *map(float, box())) for i in range(rng.randint(0, 5))]
        truth += [(s, *v) for v in t]
        other += [(s, *v) for v in p]

        def share(a, b):
            both = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
            return both / max((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both, 1)

        free = list(p)
        for a in t:
            best = max(free, key=lambda b: share(a, b), default=None)  # noqa: B023
            if best and share(a, best) >= 0.2:
                pairs.add((s, a[0], best[0], round(share(a, best), 6)))
                free.remove(best)
        w, n = [(rng.randrange(40) / 2, i) for i in range(rng.randint(0, 5))], [(rng.randrange(40) / 2, i) for i in range(rng.randint(0, 5))]
        words += [(s, i, x) for x, i in w]
        notes += [(s, i, x) for x, i in n]
        used = set()
        for x, i in sorted(w):
            near = [(j in used, abs(y - x), j) for y, j in n if abs(y - x) <= 2.5]
            if near:
                used.add(min(near)[2])
                taken.add((s, i, min(near)[2]))
    boxes_of = lambda rows: spark.createDataFrame(rows, "s long, box_id long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    assert {(r[0], r[1], r[2], round(r[3], 6)) for r in sequences.greedy_pairs(boxes_of(truth), boxes_of(other), ["s"], 0.2).collect()} == pairs
    got = sequences.match_unused(spark.createDataFrame(words, "s long, word_id long, x double"), spark.createDataFrame(notes, "s long, note_id long, x double"), ["s"])
    assert {tuple(r) for r in got.collect()} == taken


def test_row_order_does_not_matter(spark):
    rng = random.Random(1)
    rows = [(1, i, float(rng.randrange(100)), float(rng.randrange(60)), 10.0) for i in range(60)]
    schema = "s long, box_id long, cx double, cy double, h double"
    a = {tuple(r) for r in sequences.rows_of(spark.createDataFrame(rows, schema), ["s"]).collect()}
    rng.shuffle(rows)
    assert a == {tuple(r) for r in sequences.rows_of(spark.createDataFrame(rows, schema).repartition(3), ["s"]).collect()}


def test_section_path(spark):
    rng = random.Random(3)
    names = ("verse", "chorus", "coda", "intro")
    rows, expected = [], {}
    for s in range(40):
        frames = [[rng.randint(-1, 2) for _ in names] for _ in range(rng.randint(1, 6))]
        rows += [(s, i, f) for i, f in enumerate(frames)]
        # all paths up to each label; of equal scores the later path in the alphabet is kept, at the end the first label
        best = {n: (v, [n]) for n, v in zip(names, frames[0])}
        for f in frames[1:]:
            best = {n: (lambda b: (b[0] + v, [*b[1], n]))(max((c + (1 if p[-1] == n else -1), p) for c, p in best.values())) for n, v in zip(names, f)}
        expected[s] = max(best.values(), key=lambda x: x[0])[1]
    got = {}
    for r in sequences.section_path(spark.createDataFrame(rows, "s long, page long, scores array<int>").repartition(3), ["s"], "page").orderBy("s", "page").collect():
        got.setdefault(r["s"], []).append(r["label"])
    assert got == expected


def test_repeated_phrases(spark):
    frames = spark.createDataFrame([(1, 0, "ca lên đi", 2), (1, 1, "Ca lên đi!", 1), (1, 2, "khác hẳn", 1), (2, 0, "ca lên đi", 1)], "s long, page long, phrase string, rows int")
    assert [tuple(r) for r in sequences.repeated_phrases(frames, ["s"], "page", "phrase", F.col("rows") == 1).collect()] == [(1, 1)]


def test_markers(spark):
    for t, n in (("2.", 2), ("Lời 3:", None), ("12)", 12), ("0.", None), ("x2.", None)):
        assert one(spark, text.verse_number(F.lit(t))) == (3 if t == "Lời 3:" else n)
    for t, n in (("ĐK:", "chorus"), ("Điệp khúc", "chorus"), ("Coda", "coda"), ("D.C.", "coda"), ("Kết", "coda"), ("Fine", "coda"), ("codabc", None)):
        assert one(spark, text.section_marker(F.lit(t))) == n


def test_ratio(spark):
    rng = random.Random(1)
    pairs = [("abcd", "bcde"), ("", ""), ("thuong", "thượng")] + [tuple("".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in "ab") for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select(sequences.ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_rows_to_staves(spark):
    staves = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 40.0), (1, 1, 0.0, 200.0, 100.0, 240.0), (1, 2, 200.0, 0.0, 300.0, 40.0)], "s int, staff_id int, x1 double, y1 double, x2 double, y2 double")
    rows = [(1, 0, 10.0, 50.0, 60.0, 60.0, True), (1, 1, 10.0, 62.0, 60.0, 72.0, True), (1, 2, 10.0, 150.0, 60.0, 160.0, True), (1, 3, 10.0, 300.0, 60.0, 310.0, True), (1, 4, 10.0, 312.0, 60.0, 322.0, True), (1, 5, 10.0, 332.0, 60.0, 342.0, True), (1, 6, 400.0, 50.0, 500.0, 60.0, True), (1, 7, 90.0, 45.0, 220.0, 55.0, False)]
    got = {r["row_id"]: (r["staff_id"], r["verse"], r["ambiguous"]) for r in sequences.assign_rows(spark.createDataFrame(rows, "s int, row_id int, x1 double, y1 double, x2 double, y2 double, sung boolean"), staves, ["s"]).collect()}
    assert got[0] == (0, 1, False) and got[1] == (0, 2, False) and got[2] == (None, None, False)
    assert got[3] == (1, 1, False) and got[4] == (1, 2, False) and got[5] == (1, 3, False)  # the last only because it is close to the row before
    assert got[6] == (None, None, False) and got[7] == (0, None, True)


def test_own_rule(spark):
    from neumatic.operators import ledger

    columns = "lyrics map<string,int>, lyrics_complete boolean, sung_notes int, melisma int, section_type string, slurs_known boolean, image_available boolean, image_reliable boolean, heads int, notes int, beats double, expected double, pickup boolean, tuplet_marks int, tuplets int, unexplained_ink int, continuity_conflict boolean, clef_conflict boolean, key_conflict boolean, midi array<int>, leap boolean, out_of_key int, sources_agree boolean, ocr_review int, xml_changed boolean, metadata_open boolean"
    clean = ({"1": 4}, True, 4, 0, "verse", True, True, True, 4, 4, 4.0, 4.0, False, 0, 0, 0, False, False, False, [60, 62], False, 0, True, 0, False, False)
    names = [c.split()[0] for c in columns.replace("map<string,int>", "m").split(", ")]
    changed = lambda **k: tuple(k.get(n, v) for n, v in zip(names, clean))
    cases = [(changed(), []), (changed(notes=3, sung_notes=3, sources_agree=False), ["C1", "C2", "EVIDENCE"]), (changed(lyrics={"1": 4, "2": 3}, melisma=0, sung_notes=4), ["C1", "C5"]), (changed(beats=3.0), ["C3"]), (changed(tuplet_marks=1), ["C4"]), (changed(unexplained_ink=1), ["C6"]),
             (changed(continuity_conflict=True), ["C7"]), (changed(clef_conflict=True), ["C8"]), (changed(key_conflict=True), ["C8"]), (changed(midi=[40]), ["C9"]), (changed(out_of_key=1), ["C10"]), (changed(ocr_review=2), ["OCR"]), (changed(xml_changed=True), ["XML_CHANGED"]), (changed(metadata_open=True), ["METADATA"]), (changed(image_available=False), ["EVIDENCE"])]
    frame = spark.createDataFrame([c for c, _ in cases], columns)
    found = ledger.decided(frame).collect()
    assert [[v["rule"] for v in r["violations"]] for r in found] == [e for _, e in cases]
    assert [r["decision"] for r in found] == ["accept" if e in ([], ["C9"]) else "review" for _, e in cases]
    warned = ledger.decided(spark.createDataFrame([changed(notes=3, sung_notes=3, slurs_known=False)], columns)).first()
    assert warned["violations"][0]["severity"] == "warning"
    ledger.register_rule("LOW", when=F.array_min("midi") < 61, severity=F.lit("info"), message=F.lit("low"))
    try:
        assert [v["rule"] for v in ledger.decided(frame).first()["violations"]] == ["LOW"]
    finally:
        ledger.unregister_rule("LOW")
    assert not ledger.decided(frame).first()["violations"]


def test_artifacts_are_whole(spark, tmp_path):
    from neumatic.sources import artifacts

    path = f"file://{tmp_path}/ledger"
    artifacts.write_artifact(spark.range(3), path)
    artifacts.write_artifact(spark.range(5), path)
    (tmp_path / "ledger" / "data" / "broken").mkdir()
    (tmp_path / "ledger" / "data" / "broken" / "part.json").write_text('{"id": 99}')
    got = artifacts.read_artifact(spark, path, "id long, later string").collect()
    assert sorted(r["id"] for r in got) == list(range(5)) and {r["later"] for r in got} == {None}
