"""What queries move: exchanges of plans, rows met, tasks; with results on odd input."""

from neumatic.operators import review


def exchanges(frame) -> int:
    """Exchanges of the plan as it is before it runs."""
    return sum("Exchange " in line and "Reused" not in line and "Broadcast" not in line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines())


def test_confirmations_move_each_row_once(spark):
    odd = [("b", "x\\", "y\x1f", "p _", "1:1"), ("b", "x\\", "y\x1f", "p _", "1:1"), ("b", "x\\", "y\x1f", "p _", "1:2"), ("b", "x\\", "y\x1f", "p _", "2:1"), (None, "", "\\0", "\\m\\b\\ _", "3:1"), ("", None, "\\0", "\\m\\b\\ _", "3:1"), ("b", "x\\", "y", "\x1fp _", "4:1"), ("c", "e", "f", "g", None)]
    out = review.confirmations(spark.createDataFrame(odd, "book string, before string, after string, context string, event string"))
    assert exchanges(out) == 1
    assert {tuple(r) for r in out.collect()} == {("b", "x\\", "y\x1f", "p _", 3, 2), (None, "", "\\0", "\\m\\b\\ _", 1, 1), ("", None, "\\0", "\\m\\b\\ _", 1, 1), ("b", "x\\", "y", "\x1fp _", 1, 1), ("c", "e", "f", "g", 1, 1)}


def test_corrections_of_a_text_are_not_moved(spark, tmp_path):
    from neumatic.plans.review import corrections

    rows = [(1, "a b c d", "en"), (2, "", "en"), (3, None, "en"), (4, "a b", None), (5, "x  y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = corrections(spark, str(tmp_path))
    assert exchanges(out) == 0
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("en", "b", "c", "a _", "1:1"), ("en", "c", "d", "b _", "1:1"), (None, "", "y", "x _", "5:0")], key=str)


def test_small_files_share_a_task(tmp_path):
    from neumatic.sources import archives

    for i in range(300):
        (tmp_path / f"{i}.musicxml").write_text('<score-partwise><part id="P1"><measure number="1"/></part></score-partwise>' if i != 7 else "<broken")
    reader = archives.ScoreReader({"path": str(tmp_path)})
    tasks = reader.partitions()
    assert len(tasks) == 1
    rows = [r for t in tasks for r in reader.read(t)]
    at, why = archives.NAMES.index("path"), archives.NAMES.index("error")
    assert len({r[at] for r in rows}) == 300 and [r[at].rsplit("/", 1)[1] for r in rows if r[why]] == ["7.musicxml"]
    few = archives.ScoreReader({"path": str(tmp_path), "taskbytes": str(100 * (archives.OPENING + 100))}).partitions()
    assert 2 < len(few) < 5 and sum(len(t.shares) for t in few) == 300


def test_likeness_is_solved_over_many_batches(spark, monkeypatch):
    import random

    from neumatic.operators import sequences
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = [None, "", "a", "ab", "abc", "xabcx", "zzz"]
    rows = [(i, rng.choice(words), rng.choice(words)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i long, a string, b string").union(spark.range(3000, 3200).select("id", F.lit(None).cast("string"), F.lit(None).cast("string"))).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["i"]: r["r"] for r in frame.select("i", sequences.ratio("a", "b").alias("r")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = {(a, b): float(sequences.block_ratios([a], [b])[0]) for a in words for b in words if a is not None and b is not None}
    assert len(got) == 3200 and all(got[i] == plain.get((a, b)) for i, a, b in rows) and got[3100] is None
    import pandas as pd

    calls = []
    solve = sequences.block_ratios
    monkeypatch.setattr(sequences, "block_ratios", lambda a, b: calls.append(len(a)) or solve(a, b))
    parts = [(pd.Series(["a", "b", None]), pd.Series(["a", "c", "x"]))] * 50
    out = pd.concat(sequences.ratio.func(iter(parts)))
    assert calls == [2] and len(out) == 150 and out.iloc[:2].tolist() == [1.0, 0.0] and out.iloc[2] != out.iloc[2]


def test_tasks_of_the_ledger_hold_as_much_whatever_the_tables_hold(spark, monkeypatch):
    from pyspark.sql import functions as F

    from neumatic.plans import core, ledger

    sf = "/root/testdata/sf0.001"
    whole = lambda f: f.select(F.count("*"), F.expr("bit_xor(xxhash64(*))")).first()
    before = whole(ledger.ledger(spark, sf).drop("lyrics"))
    words = core.tokens(spark, sf).count()
    monkeypatch.setattr(core, "EVENTS_OF_TASK", 500)
    monkeypatch.setattr(core, "TEXTS_OF_TASK", 25)
    events, texts = -(-core.table(spark, sf, "lineitem").count() // 500), -(-core.table(spark, sf, "documents").count() // 25)
    plan = ledger.ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert f", {events}), REPARTITION_BY_NUM" in plan and f", {texts}), REPARTITION_BY_NUM" in plan
    assert whole(ledger.ledger(spark, sf).drop("lyrics")) == before
    together = core.tokens(spark, sf, together=True)
    assert together.count() == words and whole(together) == whole(core.tokens(spark, sf))
    assert exchanges(together.groupBy("score_id", "line").count()) == 1


def test_structure_tree_moves_texts_once(spark):
    from neumatic.queries import queries

    assert exchanges(queries()["a15_structure_tree"](spark, "/root/testdata/sf0.001")) == 1


def test_lyric_audit_moves_texts_once(spark):
    from neumatic.operators import accuracy
    from neumatic.queries import queries
    from pyspark.sql import functions as F

    assert exchanges(queries()["q19_lyric_audit"](spark, "/root/testdata/sf0.001")) == 1
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, None), (1, 1, "c"), (2, 1, "d"), (None, 0, ""), (3, 3, "x")]
    f = spark.createDataFrame(rows, "k long, pos long, text string")
    kept, read = F.col("pos") != 1, F.when(F.col("pos") == 3, "y").otherwise(F.col("text"))
    both = accuracy.compared_within(f, ["k"], "pos", F.col("text"), kept, read)
    apart = accuracy.compared(f, f.where(kept).withColumn("text", read), ["k"], "pos", "text")
    assert sorted(map(str, both.where("k is not null").collect())) == sorted(map(str, apart.where("k is not null").collect()))
    # as in SQL, rows without a key are one group
    assert [tuple(r) for r in both.where("k is null").collect()] == [(None, [""], [""], 0)]


def test_only_samples_are_measured(spark):
    from neumatic.queries import queries

    plan = queries()["q18_corpus_benchmark"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 5


def test_proposals_are_worked_out_once(spark):
    from neumatic.queries import queries

    plan = queries()["w20_repaired_lengths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_line_roles_move_texts_and_not_words(spark):
    from neumatic.queries import queries

    plan = queries()["x9_band_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(score_id" not in plan


def test_frames_of_sections_do_not_move_words(spark, monkeypatch, tmp_path):
    from neumatic.plans import sequences as plans

    words = ["a", "sixteen", "letters"]
    rows = [(1, " ".join(words[i % 3] for i in range(70))), (2, ""), (3, None), (None, "longest words here")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    held = plans.computed
    monkeypatch.setattr(plans, "computed", lambda f: seen.append((exchanges(f), f._jdf.queryExecution().optimizedPlan().toString())) or held(f))
    out = plans.d5(spark, str(tmp_path))
    # the frames: texts go out once, and no word becomes several rows
    assert seen[-1][0] == 1 and "Expand" not in "".join(p for _, p in seen)
    assert sorted((r["score_id"] or 0, r["page"]) for r in out.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_flags_of_words_and_notes_are_not_joined(spark):
    from neumatic.operators import lyrics

    words = [(1, 0, 0, 0.0, 1.0, False), (1, 0, 1, 9.0, 1.0, True), (1, 0, 1, 9.0, 1.0, True), (1, 1, 2, 0.0, 1.0, None), (2, 0, 0, 0.0, 1.0, None)]
    notes = [(1, 0, 5, 0.0, False, False, False), (1, 0, 6, 9.0, False, False, None), (1, 0, 7, 9.0, False, False, False), (1, 1, 8, 0.0, False, False, True), (1, 1, 9, 3.0, False, False, False)]
    w = spark.createDataFrame(words, "score_id long, line long, word_id long, x double, confidence double, geometry_review boolean")
    n = spark.createDataFrame(notes, "score_id long, line long, note_id long, x double, slurred boolean, continued boolean, fallback boolean")
    out = lyrics.aligned_staffs(w, n, ["score_id", "line"], ["score_id", "line"])
    assert exchanges(out) == 1
    got = sorted((r["score_id"], r["line"], r["word_id"], r["status"], r["reason"]) for r in out.collect())
    assert got == [(1, 0, 0, "accepted", None), (1, 0, 1, "needs_review", "syllable_geometry_fallback"), (1, 0, 1, "needs_review", "syllable_geometry_fallback"), (1, 1, 2, "needs_review", "musicxml_fallback"), (2, 0, 0, "no_note_candidate", "no_note_candidate")]


def test_steps_of_geometry_are_packed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from neumatic.operators import shared
    from neumatic.plans import scores

    frame = spark.range(20_000).select("id", (F.col("id") % 3).cast("int").alias("k"), F.lit(None).cast("string").alias("none"), F.array(F.struct(F.lit("a").alias("x"))).alias("l"))
    out = shared.stored(frame, "packed")
    assert out.schema.simpleString() == frame.schema.simpleString() and out.exceptAll(frame).count() == 0 == frame.exceptAll(out).count()
    assert shared.stored(frame.limit(0), "none").count() == 0
    names = []
    monkeypatch.setattr(scores, "stored", lambda f, name: names.append(name) or shared.stored(f, name))
    assert scores.s9_heads(spark, "/root/testdata/sf0.001").count() > 0 and sorted(names) == ["events", "heads"]
