"""Queries over the sequence operators (rows without SQL; tests compare them with plain versions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import measures as m
from ..operators import sequences as ops
from ..operators.shared import computed
from ..registry import query
from . import core


def sung_words(spark, sf_dir):
    t = core.tokens(spark, sf_dir)
    return t.select("score_id", "line", F.col("pos").alias("word_id"), F.col("x").cast("double").alias("x"), "confidence", (F.length("text") <= 6).alias("known"), (F.col("pos") % 37 == 0).alias("geometry_review"))


def line_notes(spark, sf_dir):
    """Notes of measure k of a score are those of its line k; slurs by number are open from their start on and until after their stop."""
    n = core.notes(spark, sf_dir).where("not is_rest and not is_chord")
    w = Window.partitionBy("measure_key", "staff").orderBy("seq")
    started = F.sum(F.col("slur_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stopped = F.coalesce(F.sum(F.col("slur_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("slurred", started > stopped)
    return n.select("score_id", F.col("measure_idx").alias("line"), (100 * F.col("measure_idx") + F.col("note_index")).alias("note_id"), "x", "slurred", (F.col("slurred") & ~F.col("slur_start")).alias("continued"))


def aligned(spark, sf_dir, pixel=False):
    return ops.align_lyrics(sung_words(spark, sf_dir), line_notes(spark, sf_dir), ["score_id", "line"], pixel=pixel)


@query("d3_align_lyrics")
def d3(spark, sf_dir):
    return ops.align_lyrics(sung_words(spark, sf_dir).drop("geometry_review"), line_notes(spark, sf_dir), ["score_id", "line"])


@query("d3_align_lyrics_pixel")
def d3_pixel(spark, sf_dir):
    w, n = sung_words(spark, sf_dir).drop("geometry_review"), line_notes(spark, sf_dir)
    scale = lambda f: f.withColumn("x", F.col("x") / 10.0)
    return ops.align_lyrics(scale(w), scale(n), ["score_id", "line"], pixel=True)


@query("d4_alignment_status")
def d4(spark, sf_dir):
    return aligned(spark, sf_dir).select("score_id", "word_id", "status", "confidence")


@query("a6_alignment_summary")
def a6(spark, sf_dir):
    """Accepted and other words per score and line section, with the score's totals."""
    a = aligned(spark, sf_dir).withColumn("section", F.when(F.col("line") % 5 == 4, "chorus").otherwise("verse"))
    ok = F.count_if(F.col("status") == "accepted")
    return a.rollup("score_id", "section").agg(ok.alias("accepted"), (F.count("*") - ok).alias("review"), F.grouping_id().alias("level")).where("level <= 1").select("score_id", F.coalesce("section", F.lit("all")).alias("section"), "accepted", "review")


@query("w18_melisma_runs")
def w18(spark, sf_dir):
    """How many notes after each matched note carry its syllable on: unmatched, and slurred together without a gap."""
    n, found = line_notes(spark, sf_dir), aligned(spark, sf_dir).where("note_id is not null").select("score_id", "line", "note_id").withColumn("hit", F.lit(True))
    w = Window.partitionBy("score_id", "line").orderBy("x", "note_id")
    j = n.join(found, ["score_id", "line", "note_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    j = j.withColumn("run", F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    inside = Window.partitionBy("score_id", "line", "run").orderBy("x", "note_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.bool_and(F.col("slurred")).over(inside) & ~F.col("hit")
    return j.withColumn("carried", carried).groupBy("score_id", "line", "run").agg(F.min_by("note_id", F.struct("x", "note_id")).alias("note_id"), F.count_if("carried").alias("melisma")).drop("run")


@query("d6_text_rows")
def d6(spark, sf_dir):
    return ops.rows_of(page_boxes(spark, sf_dir), ["score_id", "page"])


def page_boxes(spark, sf_dir):
    t = core.tokens(spark, sf_dir)
    return t.select("score_id", "page", F.col("pos").alias("box_id"), F.col("x").cast("double").alias("cx"), (20.0 * (F.col("line") % 4) + F.length("text") % 7).alias("cy"), (10.0 + F.length("text") % 5).alias("h"))


@query("w19_row_numbers")
def w19(spark, sf_dir):
    """Number of each text row of a page from the top, and its words."""
    r = ops.rows_of(page_boxes(spark, sf_dir), ["score_id", "page"])
    w = Window.partitionBy("score_id", "page").orderBy("text_row")
    return r.groupBy("score_id", "page", "text_row").agg(F.count("*").alias("words"), F.min("box_id").alias("first_box")).withColumn("row_number", F.dense_rank().over(w)).drop("text_row")


@query("d5_section_path")
def d5(spark, sf_dir):
    # texts are moved whole; a set of verses instead of distinct ones, as those would make each word several rows
    t = core.tokens(spark, sf_dir, together=True)
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    frames = t.groupBy("score_id", "page").agg(F.size(F.collect_set(F.when(F.length("text") > 6, F.col("verse")))).cast("long").alias("rows"), F.bool_or(text.verse_number(F.col("text")).isNotNull()).alias("explicit"), F.max(text.section_marker(F.col("text"))).alias("marker"), phrase.alias("phrase"))
    # computed by itself: else the planner runs it a second time to filter the other side of the join
    again = computed(ops.repeated_phrases(frames, ["score_id"], "page", "phrase", F.col("rows") == 1)).withColumn("again", F.lit(True))
    frames = computed(frames.drop("phrase"))
    counts = ops.verse_count(frames, ["score_id"], "page", "rows")
    last = frames.groupBy("score_id").agg(F.max("page").alias("last"))
    f = frames.join(counts, "score_id").join(last, "score_id").join(again, ["score_id", "page"], "left")
    scored = f.withColumn("scores", ops.emissions(F.col("rows"), F.col("verse_count"), F.col("explicit"), F.col("page") == F.col("last"), F.col("marker"), F.coalesce("again", F.lit(False))))
    return ops.section_path(scored.select("score_id", "page", "scores"), ["score_id"], "page")


@query("a16_verse_count", """, f AS (SELECT score_id, page, count(DISTINCT CASE WHEN length(text) > 6 THEN verse END) AS n FROM tokens GROUP BY ALL),
c AS (SELECT score_id, n, count(*) AS k, min(page) AS first FROM f WHERE n >= 2 GROUP BY ALL), b AS (SELECT score_id, n FROM c QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY k DESC, first) = 1)
SELECT s.score_id, coalesce(b.n, 1) AS verse_count FROM (SELECT DISTINCT score_id FROM f) s LEFT JOIN b USING (score_id)""")
def a16(spark, sf_dir):
    t = core.tokens(spark, sf_dir)
    frames = t.groupBy("score_id", "page").agg(F.countDistinct(F.when(F.length("text") > 6, F.col("verse"))).alias("n"))
    return ops.verse_count(frames, ["score_id"], "page", "n")


@query("j7_match_unused")
def j7(spark, sf_dir):
    words = core.tokens(spark, sf_dir).select("score_id", "line", F.col("pos").alias("word_id"), F.col("x").cast("double").alias("x"))
    notes = core.notes(spark, sf_dir).where("not is_rest").select("score_id", F.col("measure_idx").alias("line"), (100 * F.col("measure_idx") + F.col("note_index")).alias("note_id"), "x")
    return ops.match_unused(words, notes, ["score_id", "line"], 12.0)


@query("j12_greedy_overlap")
def j12(spark, sf_dir):
    t = core.tokens(spark, sf_dir)
    box = lambda dx: [F.col("pos").alias("box_id"), (F.col("x") + dx).cast("double").alias("x1"), (20.0 * F.col("line")).alias("y1"), (F.col("x") + dx + 3 * F.length("text")).cast("double").alias("x2"), (20.0 * F.col("line") + 12).alias("y2")]
    return ops.greedy_pairs(t.select("score_id", "line", *box(0)), t.where("pos % 5 <> 0").select("score_id", "line", *box(2)), ["score_id", "line"])


@query("x17_similar_neighbours")
def x17(spark, sf_dir):
    """How like each word is to the one after it; texts are moved whole, so no word is sorted."""
    t, _ = core.word_lists(spark, sf_dir)
    t = ops.neighbour_ratios(t.select("score_id", "places", "words"), "words").select("score_id", "places", F.posexplode("ratios").alias("i", "ratio"))
    return t.select("score_id", F.coalesce(F.get("places", F.col("i")), F.col("i").cast("long")).alias("pos"), F.round("ratio", 6).alias("ratio"))
