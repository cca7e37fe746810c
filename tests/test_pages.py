"""Numbering, staff rows and sections over pages and parts against plain versions."""

import random
from statistics import median

from neumatic.operators import measures, structure


def test_parts_are_numbered_through_their_pages(spark):
    rng = random.Random(6)
    entries = []
    for score in range(40):
        for part in ("P1", "P2", "P3"):
            for page in range(1, 5):
                if rng.random() < 0.3:
                    continue
                start, nth = rng.choice([0, 1, 5]), 0
                for local in sorted(rng.choice(range(1, 6)) for _ in range(rng.randint(1, 5))):
                    nth += 1
                    entries.append((score, part, page, nth, str(local), start + local - 1, rng.choice([None, None, 3.0, 4.0])))
    out = {tuple(r)[:4]: (r["number"], r["expected"]) for r in measures.merged(spark.createDataFrame(entries, "score_id long, part_id string, page int, nth int, local_number string, own_number long, expected_given double")).collect()}
    last, beats, number = {}, {}, {}
    for score, part, page, nth, local, own, given in sorted(entries, key=lambda e: (e[0], e[2], e[1], e[3])):
        key = (score, part, page, local)
        if key not in number:
            number[key] = own if page == 1 else last.get((score, part), 0) + 1
            last[score, part] = number[key]
        if given is not None:
            beats[score, part] = given
        assert out[score, part, page, nth] == (number[key], beats.get((score, part)))


def test_rows_of_staves(spark):
    bars = [(1, p, i, i in (1, 3), i in (2, 4), None if i == 1 else 50.0) for p in ("P1", "P2") for i in range(1, 5)]
    notes = [(1, "P1", 1, 1, 1, 7.0), (1, "P1", 1, 2, 1, 7.0), (1, "P2", 2, 2, 1, 7.0), (1, "P2", 2, 4, 2, 7.0), (1, "P1", 1, 4, 1, 3.0)]
    n = spark.createDataFrame(notes, "score_id long, part_id string, part_idx int, measure_idx int, staff int, local_x double")
    m = spark.createDataFrame(bars, "score_id long, part_id string, measure_idx int, new_page boolean, new_system boolean, width double")
    got = sorted((r["part_id"], r["measure_idx"], r["page"], r["system"], r["row"], r["x"]) for r in measures.staff_rows(n, m).collect())
    assert got == [("P1", 1, 2, 0, 0, 7.0), ("P1", 2, 2, 1, 3, 7.0), ("P1", 4, 3, 1, 3, 3.0), ("P2", 2, 2, 1, 4, 7.0), ("P2", 4, 3, 1, 5, 7.0)]


def plain(pages):
    """Each page takes the chorus from the one before, in order."""
    out = {(p, w["seq"]): [w["section_type"], None, False] for p, ws in pages.items() for w in ws}
    for page in sorted(pages):
        before, here = pages.get(page - 1), pages[page]
        if not before:
            continue
        tail = [w for w in before if w["system"] == max(v["system"] for v in before)]
        ending = max(tail, key=lambda w: w["x"])
        if out[page - 1, ending["seq"]][0] != "chorus" or any(w["explicit"] for w in here) or len({w["verse"] for w in here}) > 1:
            continue
        for w in here:
            out[page, w["seq"]] = ["chorus", "previous_page_chorus", w is here[0]]
        chorus = [w for w in tail if out[page - 1, w["seq"]][0] == "chorus"]
        y, h, x = median(w["y"] for w in chorus), median(w["h"] for w in chorus), min(w["x"] for w in chorus)
        for w in sorted((w for w in tail if abs(w["y"] - y) < 0.6 * h and w["x"] < x), key=lambda w: -w["x"]):
            if any(abs(o["x"] - w["x"]) < 0.6 * h and abs(o["y"] - y) > 0.7 * h for o in tail):
                break
            out[page - 1, w["seq"]] = ["chorus", "single_row_tail_before_page_break", True]
    return out


def test_choruses_go_on_over_page_breaks(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for score in range(150):
        pages = {}
        for page in range(1, 6):
            if rng.random() < 0.1:
                continue
            one, loud = rng.random() < 0.7, rng.random() < 0.15
            ws = [{"seq": i, "system": rng.randint(0, 1), "x": float(10 * i + rng.randint(0, 3)), "y": rng.choice([0.0, 1.0, 15.0]), "h": 10.0, "section_type": rng.choice(["chorus", "verse"]), "verse": 1 if one else rng.randint(1, 2), "explicit": loud and i == 0} for i in range(rng.randint(1, 8))]
            pages[page] = ws
            rows += [(score, page, *w.values()) for w in ws]
        want |= {(score, *k): tuple(v) for k, v in plain(pages).items()}
    words = spark.createDataFrame(rows, "score_id long, page int, seq int, system int, x double, y double, h double, section_type string, verse int, explicit boolean").repartition(3)
    got = {(r["score_id"], r["page"], r["seq"]): (r["section"], r["reason"], r["review"]) for r in structure.connected(words, ["score_id"]).collect()}
    assert got == want
    assert {r for _, r, _ in want.values()} == {None, "previous_page_chorus", "single_row_tail_before_page_break"}
