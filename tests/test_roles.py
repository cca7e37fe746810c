"""Roles of text lines on hand-made lines, and their accuracy against a plain count."""

import random

from neumatic.operators import roles, sequences

LINES = [
    ("above", "Am Dm7 G", "chord"), ("above", "Em", "chord"), ("above", "em đi chợ Em", "unknown"), ("above", "Vừa phải, êm", "tempo"), ("above", "Tempos", "unknown"),
    ("above", "key: D", "key_info"), ("above", "D.C. al Fine", "direction"), ("above", "Fine", "direction"), ("below", "điệp khúc:", "section_marker"), ("between", "Đ.K.", "section_marker"),
    ("below", "Lời 2", "verse_marker"), ("below", "3.", "verse_marker"), ("below", "Am Dm", "lyric"), ("between", "mẹ ra chợ", "lyric"), ("foot", "27", "unknown"), (None, "trang", "unknown")]


def test_line_roles(spark):
    words = [(i, p, w, band) for i, (band, text, _) in enumerate(LINES) for p, w in enumerate(text.split())]
    got = {r["k"]: r for r in roles.line_roles(spark.createDataFrame(words, "k int, pos int, text string, band string").repartition(3), ["k"]).collect()}
    assert [(got[i]["text"], got[i]["role"], got[i]["needs_review"]) for i in range(len(LINES))] == [(t, r, r == "unknown") for _, t, r in LINES]
    assert got[0]["chord_ratio"] == 1.0 and got[13]["syllable_ratio"] == 1.0 and got[2]["chord_ratio"] == 0.25


def test_role_accuracy(spark):
    rng = random.Random(2)
    side = lambda: [(k, i, 0.0, 10.0 * i + rng.uniform(-4, 4), 50.0, 10.0 * i + 9, rng.choice(["lyric", "chord"])) for k in range(6) for i in range(5) if rng.random() < 0.8]
    a, b = side(), side()
    shape = "k int, box_id long, x1 double, y1 double, x2 double, y2 double, role string"
    t, p = spark.createDataFrame(a, shape), spark.createDataFrame(b, shape)
    pairs = {(r["k"], r["truth_id"]): r["predicted_id"] for r in sequences.greedy_pairs(t.drop("role"), p.drop("role"), ["k"]).collect()}
    found = {(k, i): role for k, i, *_, role in b}
    got = {r["k"]: (r["lines"], r["text_role_accuracy"]) for r in roles.role_accuracy(t, p, ["k"]).collect()}
    for k in {r[0] for r in a}:
        own = [(i, role) for g, i, *_, role in a if g == k]
        right = sum(found.get((k, pairs.get((k, i)))) == role for i, role in own)
        assert got[k] == (len(own), round(right / len(own), 6))


def test_queries(spark):
    from neumatic.queries import queries

    sf = "/root/testdata/sf0.001"
    found = {r["role"] for r in queries()["x9_band_roles"](spark, sf).select("role").distinct().collect()}
    assert {"chord", "tempo", "direction", "section_marker", "verse_marker", "lyric", "unknown"} <= found
    assert queries()["q18_role_accuracy"](spark, sf).where("text_role_accuracy < 1").count() > 0
