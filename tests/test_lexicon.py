"""Words that few texts have are brought to their texts; with results on odd input."""

from collections import defaultdict

from pyspark.sql import functions as F


def test_rare_words_are_brought_to_their_texts(spark):
    from neumatic.operators import lexicon

    rows = [(1, "a b c  é"), (1, "a z"), (2, "a b"), (3, "a a a b b"), (None, "a q b n"), (None, "q c"), (4, ""), (5, " c"), (6, None), (7, "y"), (8, "y")]
    keys = defaultdict(set)
    for k, text in rows:
        for w in (text or "").split(" ") if text is not None else []:
            keys[w] |= {k} - {None}
    d = spark.createDataFrame(rows, "doc_id long, text string").where("text is not null")
    counted = lexicon.counted(d.repartition(3, "doc_id"), 3, F.col("word") == "a")
    assert {r["word"]: r["n"] for r in counted.collect()} == {w: len(k) for w, k in keys.items() if len(k) < 3 or w == "a"}
    out = lexicon.with_rare(d, counted.where("n < 3"), 3).select("doc_id", "pos", "text", "rare")
    expected = [(k, pos, w, len(keys[w]) < 3) for k, text in rows if text is not None for pos, w in enumerate(text.split(" "))]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_line_roles_do_not_move_their_words_to_the_lexicon(spark):
    from neumatic.queries import queries

    plan = queries()["x9_line_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(w#" not in plan and "hashpartitioning(text#" not in plan
