"""Queries over the measure ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy
from ..operators import ledger as ops
from ..operators import measures as m
from ..registry import query
from . import core
from .measures import RHYTHM, SUNG

#: Words of a score land on its measures in turn; the image evidence is derived from the notes.
INPUTS = RHYTHM + SUNG + """, n_measures AS (SELECT score_id, count(*) AS n FROM measures GROUP BY score_id),
placed AS (
  SELECT m.measure_key, 1 + t.pos % 2 AS staff, t.verse, regexp_matches(t.text, '[a-zA-Z]') AS has_letter, t.confidence < 0.62 AS needs_review, CASE WHEN t.line % 5 = 4 THEN 'chorus' ELSE 'verse' END AS section_type
  FROM tokens t JOIN n_measures k USING (score_id) JOIN measures m ON m.score_id = t.score_id AND m.measure_idx = 1 + t.pos % k.n),
image AS (
  SELECT measure_key, staff, count(*) FILTER (NOT is_rest AND NOT is_grace) + CASE WHEN measure_key % 8 = 0 THEN 1 ELSE 0 END AS heads, measure_key % 10 <> 0 AS available, measure_key % 3 <> 0 AS reliable,
    CASE WHEN measure_key % 14 = 0 THEN 0 ELSE count(*) FILTER (is_tuplet) END AS tuplet_marks, CASE WHEN measure_key % 12 = 0 THEN 1 ELSE 0 END AS ink FROM notes GROUP BY measure_key, staff),
slurred AS (SELECT *, coalesce(last_value(CASE WHEN slur_start THEN 1 WHEN slur_stop THEN 0 END IGNORE NULLS) OVER (PARTITION BY measure_key, staff ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM sung),
s AS (SELECT measure_key, staff, count(*) AS sung_notes, sum(open) AS melisma, bool_or(midi < 57 OR midi > 81) AS out_of_range FROM slurred GROUP BY ALL),
led AS (SELECT *, lead(midi, 1) OVER w AS n1, lead(midi, 2) OVER w AS n2 FROM sung WINDOW w AS (PARTITION BY measure_key, staff ORDER BY seq)),
leap AS (SELECT measure_key, staff, bool_or(coalesce(abs(n1 - midi) > 12 AND abs(n2 - midi) <= 2, false)) AS leap FROM led GROUP BY ALL),
a AS (SELECT score_id, measure_key, measure_idx, staff, count(*) FILTER (NOT is_rest AND NOT is_grace) AS notes, count(*) FILTER (is_tuplet) AS tuplets FROM notes GROUP BY ALL),
v AS (SELECT measure_key, staff, verse, count(*) AS n FROM placed WHERE has_letter GROUP BY ALL),
vv AS (SELECT measure_key, staff, max(n) AS most, min(n) AS least FROM v GROUP BY ALL),
w AS (SELECT measure_key, staff, count(*) FILTER (needs_review) AS ocr_review, CASE WHEN min(section_type) = max(section_type) THEN min(section_type) ELSE 'mixed' END AS section_type FROM placed GROUP BY ALL),
h AS (SELECT e.measure_key, count(*) FILTER (((CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + alter_by - 7 * fifths) % 12 + 12) % 12 NOT IN (0,2,4,5,7,9,11,3,8,10)) AS out_of_key
  FROM score_events e JOIN rhythm r USING (measure_key) WHERE kind = 'harmony' GROUP BY ALL),
ev AS (
  SELECT a.*, coalesce(sung_notes, 0) AS sung, coalesce(melisma, 0) AS mel, actual, expected, pickup, coalesce(leap, false) AS leap, coalesce(out_of_range, false) AS out_of_range, coalesce(out_of_key, 0) AS out_of_key, most, least,
    ocr_review IS NOT NULL AS complete, coalesce(ocr_review, 0) AS ocr, coalesce(section_type, 'mixed') AS section, heads, available, reliable, tuplet_marks, ink
  FROM a JOIN rhythm USING (measure_key) LEFT JOIN s USING (measure_key, staff) LEFT JOIN leap USING (measure_key, staff) LEFT JOIN h USING (measure_key) LEFT JOIN vv USING (measure_key, staff) LEFT JOIN w USING (measure_key, staff) LEFT JOIN image USING (measure_key, staff)),
fired AS (
  SELECT *, list_filter([
    CASE WHEN complete AND most IS NOT NULL AND (most > sung OR (section <> 'mixed' AND sung - least > mel)) THEN 'C1:' || CASE WHEN measure_key % 6 <> 0 THEN 'error' ELSE 'warning' END END,
    CASE WHEN available AND heads <> notes THEN 'C2:' || CASE WHEN reliable THEN 'error' ELSE 'warning' END END,
    CASE WHEN expected <> 0 AND abs(actual - expected) > 0.001 AND NOT pickup THEN 'C3:error' END,
    CASE WHEN tuplet_marks > 0 AND tuplets = 0 THEN 'C4:error' WHEN tuplets > 0 AND tuplet_marks = 0 AND available THEN 'C4:warning' END,
    CASE WHEN complete AND section <> 'mixed' AND most - least > mel THEN 'C5:warning' END,
    CASE WHEN ink > 0 THEN 'C6:warning' END,
    CASE WHEN measure_key % 45 = 7 THEN 'C7:warning' END, CASE WHEN measure_key % 40 = 3 OR measure_key % 35 = 1 THEN 'C8:error' END,
    CASE WHEN most IS NOT NULL AND (out_of_range OR leap) THEN 'C9:info' END,
    CASE WHEN out_of_key > 0 THEN 'C10:warning' END,
    CASE WHEN NOT available OR heads <> notes THEN 'EVIDENCE:warning' END,
    CASE WHEN ocr > 0 THEN 'OCR:warning' END, CASE WHEN measure_key % 50 = 5 THEN 'XML_CHANGED:warning' END, CASE WHEN measure_idx = 1 AND score_id % 9 = 0 THEN 'METADATA:warning' END], lambda x: x IS NOT NULL) AS violations FROM ev),
ledger AS (SELECT *, CASE WHEN len(list_filter(violations, lambda x: NOT x LIKE '%:info')) > 0 THEN 'review' ELSE 'accept' END AS decision FROM fired)"""


def placed_words(spark, sf_dir) -> DataFrame:
    counts = core.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("score_id")).agg(F.count("*").alias("n"))
    # of the words only what the ledger asks is moved, and they are set apart where they are counted
    letters = F.transform(F.split("text", " ", -1), lambda w: w.rlike("[a-zA-Z]")).alias("letters")
    d = core.texts(spark, sf_dir, letters).withColumnRenamed("doc_id", "score_id").join(counts, "score_id")
    t = d.select("score_id", "n", F.posexplode("letters").alias("pos", "has_letter")).withColumn("pos", F.col("pos").cast("long"))
    p, line = F.col("pos"), F.floor(F.col("pos") / 8)
    return t.select("score_id", (1 + p % F.col("n")).alias("measure_idx"), (1 + p % 2).alias("staff"), (1 + line % 3).alias("verse"), "has_letter", (core.confidence() < 0.62).alias("needs_review"), F.when(line % 5 == 4, "chorus").otherwise("verse").alias("section_type"))


def with_image(rows: DataFrame) -> DataFrame:
    k = F.col("measure_key")
    return rows.withColumns({"heads": F.col("notes") + F.when(k % 8 == 0, 1).otherwise(0), "available": k % 10 != 0, "reliable": k % 3 != 0, "tuplet_marks": F.when(k % 14 == 0, 0).otherwise(F.col("tuplets")), "ink": F.when(k % 12 == 0, 1).otherwise(0)})


def ledger(spark, sf_dir) -> DataFrame:
    k = F.col("measure_key")
    flags = {"slurs_known": k % 6 != 0, "continuity_conflict": k % 45 == 7, "clef_conflict": k % 40 == 3, "key_conflict": k % 35 == 1, "xml_changed": k % 50 == 5, "metadata_open": (F.col("measure_idx") == 1) & (F.col("score_id") % 9 == 0)}
    carried = m.carried(core.measures(spark, sf_dir)).select("score_id", "part_id", "measure_key", "measure_idx", "divisions", "beats", "beat_type", "fifths")
    return ops.decided(ops.evidence(core.events_of(spark, sf_dir, carried, "left"), placed_words(spark, sf_dir), with_image, flags))


def flat(violations):
    return F.array_join(F.transform(violations, lambda v: F.concat(v["rule"], F.lit(":"), v["severity"])), ",")


@query("q13_measure_ledger", INPUTS + " SELECT measure_key, staff, notes, sung, CAST(mel AS BIGINT) AS mel, actual, expected, array_to_string(violations, ',') AS violations, decision FROM ledger")
def q13(spark, sf_dir):
    return ledger(spark, sf_dir).select("measure_key", "staff", "notes", F.col("sung_notes").alias("sung"), F.col("melisma").cast("long").alias("mel"), F.col("beats").alias("actual"), "expected", flat(F.col("violations")).alias("violations"), "decision")


@query("q1_q12_rule_totals", INPUTS + " SELECT split_part(v, ':', 1) AS rule, split_part(v, ':', 2) AS severity, count(*) AS n FROM (SELECT unnest(violations) AS v FROM ledger) GROUP BY ALL")
def rule_totals(spark, sf_dir):
    return ops.rule_totals(ledger(spark, sf_dir))


@query("t1_review_queue", INPUTS + """, q AS (SELECT score_id, measure_key, measure_idx, staff, list_min(list_transform(violations, lambda x: CASE split_part(x, ':', 2) WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END)) AS worst, split_part(violations[1], ':', 1) AS first_rule, CASE WHEN list_contains(violations, 'METADATA:warning') THEN 0 ELSE 1 END AS card FROM ledger WHERE decision = 'review')
SELECT score_id, measure_key, staff, worst, first_rule, row_number() OVER (PARTITION BY score_id ORDER BY card, worst, first_rule, measure_idx, staff, measure_key) AS place FROM q""")
def t1(spark, sf_dir):
    return ops.queue(ledger(spark, sf_dir)).select("score_id", "measure_key", "staff", "worst", "first_rule", "place")


@query("a8_review_load", INPUTS + " SELECT score_id, count(*) AS n_measures, count(*) FILTER (decision = 'review') AS to_review, avg(CASE WHEN decision = 'review' THEN 1.0 ELSE 0.0 END) AS load FROM ledger GROUP BY score_id")
def a8(spark, sf_dir):
    return ops.review_load(ledger(spark, sf_dir))


@query("q17_acceptance_benchmark", INPUTS + """, truth AS (SELECT doc_id AS score_id, quality = 1 AS correct FROM labels),
j AS (SELECT l.*, t.correct FROM ledger l JOIN truth t USING (score_id))
SELECT count(*) FILTER (decision = 'accept' AND correct) / nullif(count(*) FILTER (decision = 'accept'), 0) AS accept_precision, count(*) FILTER (decision = 'review' AND NOT correct) / nullif(count(*) FILTER (NOT correct), 0) AS error_coverage,
  count(*) FILTER (decision = 'review') / nullif(count(*), 0) AS review_load FROM j""")
def q17(spark, sf_dir):
    truth = core.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("score_id"), (F.col("quality") == 1).alias("correct"))
    j = ledger(spark, sf_dir).join(truth, "score_id")
    accept = F.col("decision") == "accept"
    share = lambda what, of: F.count_if(what & of) / F.nullif(F.count_if(of), F.lit(0))
    return j.agg(share(F.col("correct"), accept).alias("accept_precision"), share(~accept, ~F.col("correct")).alias("error_coverage"), share(~accept, F.lit(True)).alias("review_load"))


@query("q17_acceptance_gates", INPUTS + """, truth AS (SELECT doc_id AS score_id, quality = 1 AS correct FROM labels), lab AS (SELECT s.book, decision, correct FROM ledger l JOIN scores s USING (score_id) LEFT JOIN truth USING (score_id)),
sec AS (SELECT book, round(sum(greatest(0, seconds)), 2) AS human_seconds FROM review_log JOIN scores USING (score_id) GROUP BY book), src AS (SELECT book, count(*) AS verified_sources FROM scores JOIN truth USING (score_id) GROUP BY book),
g AS (SELECT book, count(*) AS total, count(correct) AS labelled, count(*) FILTER (correct AND decision = 'accept') / nullif(count(*) FILTER (correct IS NOT NULL AND decision = 'accept'), 0) AS accept_precision,
  count(*) FILTER (NOT correct AND decision = 'review') / nullif(count(*) FILTER (NOT correct), 0) AS error_coverage, count(*) FILTER (decision = 'review') / count(*) AS review_load FROM lab GROUP BY book),
t AS (SELECT *, labelled = total AS complete, coalesce(labelled = total AND accept_precision >= 0.99 AND error_coverage >= 0.95 AND review_load <= 0.20, false) AS targets_met FROM g LEFT JOIN sec USING (book) LEFT JOIN src USING (book))
SELECT book, total, labelled, accept_precision, error_coverage, review_load, human_seconds, verified_sources, complete, targets_met, targets_met AND coalesce(verified_sources, 0) >= 20 AS auto_repair FROM t""")
def q17_gates(spark, sf_dir):
    """The benchmark of each book: shares, human seconds, verified sources and gates; labels are by score and hold for its measures."""
    books = core.scores(spark, sf_dir).select("score_id", "book")
    truth = core.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("score_id"), (F.col("quality") == 1).alias("correct"))
    source = F.lit(None).cast("string").alias("source_sha256")
    m = ledger(spark, sf_dir).select("score_id", "decision").join(books, "score_id").select("book", F.col("score_id").alias("id"), "decision", source)
    labels = books.join(truth, "score_id").select("book", F.col("score_id").alias("id"), "correct", F.lit(True).alias("verified"), source)
    seconds = core.review_log(spark, sf_dir).join(books, "score_id").groupBy("book").agg(F.round(F.sum(F.greatest(F.lit(0.0), "seconds")), 2).alias("human_seconds"))
    sources = books.join(truth, "score_id").groupBy("book").agg(F.count("*").alias("verified_sources"))
    return accuracy.gate(m, labels, seconds, sources, ["book"])


@query("a3_syllables_per_verse", INPUTS + " SELECT score_id, measure_idx, staff, verse, n FROM v JOIN measures USING (measure_key)")
def a3(spark, sf_dir):
    words = placed_words(spark, sf_dir)
    return words.where("has_letter").groupBy("score_id", "measure_idx", "staff", "verse").agg(F.count("*").alias("n"))
