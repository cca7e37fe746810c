"""Distances of words and letters against the plain table, with shapes of every kind."""

import random

from neumatic.operators import sequences


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_letters_equal_the_plain_table(monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcé\U0001f3b5") for _ in range(n))
    a = [some(rng.choice([0, 1, 5, 63, 64, 65, 128, 130, 200])) for _ in range(150)]
    b = [some(rng.choice([0, 1, 7, 64, 100, 190])) if rng.random() < 0.5 else x[: len(x) // 2] + some(2) + x[len(x) // 2 + 1 :] for x in a]
    want = [plain(x, y) for x, y in zip(a, b)]
    assert sequences.letter_distances(a, b).tolist() == want == sequences.edit_distances([list(x) for x in a], [list(y) for y in b]).tolist()
    assert sequences.letter_distances([], []).tolist() == []
    monkeypatch.setattr(sequences, "_BOUNDED", 100)
    monkeypatch.setattr(sequences, "_MASKS", 7)
    assert sequences.letter_distances(a, b).tolist() == want


def test_distances_of_columns(spark):
    rows = [(1, ["a", None, "b"], ["a", "b"], "ab", "b"), (2, [], [], "", ""), (3, None, ["a"], None, "a"), (4, ["a"], ["b"], "é\U0001f3b5", "e")]
    frame = spark.createDataFrame(rows, "i long, a array<string>, b array<string>, c string, d string")
    got = {r["i"]: (r["x"], r["y"]) for r in frame.select("i", sequences.edit_distance("a", "b").alias("x"), sequences.letter_distance("c", "d").alias("y")).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (None, None), 4: (1, 2)}


def test_rates_of_a_page_are_made_where_its_words_are(spark, tmp_path):
    from neumatic.queries import queries

    rows = [(1, "a b c d e f g", "en"), (2, None, "en"), (None, "x y", "en"), (3, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries()["d2_lyric_error_rates"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r["score_id"], r["page"], r["word_edits"], r["char_edits"]) for r in out.collect()) == [(1, 0, 2, 3), (3, 0, 0, 0)]
