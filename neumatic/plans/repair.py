"""Repair proposals over the corpus, with exact fractions and carried meters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rational as q
from ..operators import measures as ms
from ..operators import repair as ops
from ..operators.shared import computed
from ..registry import query
from . import core
from .measures import CARRIED

#: Lengths in quarters as a reader might see them: a third of what they are for every sixth event, nothing for grace notes.
SEEN = CARRIED + """, meter AS (SELECT *, beats * 4.0 / beat_type AS expected FROM carried),
seen AS (SELECT e.measure_key, e.seq, e.kind, e.is_chord, CASE WHEN is_grace THEN 0 ELSE duration END / (divisions * CASE WHEN seq % 6 = 0 THEN 3.0 ELSE 1 END) AS ql FROM score_events e JOIN carried USING (measure_key)),
held AS (SELECT s.*, expected, is_chord AND row_number() OVER (PARTITION BY measure_key ORDER BY seq) > 1 AS chord, ql <= 0.001 AS ghost FROM seen s JOIN meter USING (measure_key)
  WHERE kind = 'note' AND expected IS NOT NULL AND measure_key NOT IN (SELECT measure_key FROM score_events WHERE kind IN ('backup', 'forward')))"""
ALLOWED_SQL = "(VALUES " + ", ".join(f"({n / d})" for n, d in ops.ALLOWED) + ") t(v)"


def _near(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.25 ELSE (SELECT v FROM {ALLOWED_SQL} ORDER BY abs(v - ({x})), v LIMIT 1) END)"


PROPOSED = SEEN + f""", a AS (SELECT *, {_near('ql')}::DOUBLE AS near FROM held), b AS (SELECT *, CASE WHEN abs(ql - near) > 0.05 THEN near ELSE ql END AS len, NOT ghost AND NOT chord AS main FROM a),
c AS (SELECT *, sum(CASE WHEN main THEN len ELSE 0 END) OVER w - expected AS over_, max(CASE WHEN main THEN seq END) OVER w AS last_main FROM b WINDOW w AS (PARTITION BY measure_key)),
d AS (SELECT *, CASE WHEN main AND seq = last_main AND over_ > 0.01 THEN {_near('greatest(0.125, len - over_)')}::DOUBLE ELSE len END AS cut FROM c),
e AS (SELECT *, sum(CASE WHEN main THEN cut ELSE 0 END) OVER (PARTITION BY measure_key) AS total, last_value(CASE WHEN main THEN cut END IGNORE NULLS) OVER (PARTITION BY measure_key ORDER BY seq) AS own, last_value(CASE WHEN main THEN seq END IGNORE NULLS) OVER (PARTITION BY measure_key ORDER BY seq) AS owner FROM d),
f AS (SELECT *, coalesce(own, cut) AS new, CASE WHEN total > 0 AND expected - total > 0.01 THEN {_near('expected - total')}::DOUBLE ELSE 0 END AS rest FROM e),
g AS (SELECT *, abs(expected - total - rest) < 1e-9 AS fits FROM f)"""


def seen(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(events with length, measures with their meter)."""
    m = ms.carried(core.measures(spark, sf_dir)).select("measure_key", "divisions", "fifths", ops.expected_quarters(F.col("beats"), F.col("beat_type")).alias("expected"))
    e = core.score_events(spark, sf_dir).join(m.select("measure_key", "divisions"), "measure_key")
    slip = F.when(F.col("seq") % 6 == 0, 3).otherwise(1)
    return e.withColumn("length", q.fraction(F.when(F.col("is_grace"), 0).otherwise(F.col("duration")), F.col("divisions") * slip)), m


@query("w20_repair_proposals", PROPOSED + """ SELECT measure_key, seq, CASE WHEN ghost THEN 'drop' WHEN abs(ql - new) < 1e-9 THEN 'keep' WHEN over_ > 0.01 AND owner = last_main THEN 'trim' ELSE 'quantise' END AS action, CASE WHEN NOT ghost THEN round(new, 6) END AS quarters, fits FROM g
UNION ALL SELECT measure_key, max(seq) + 1, 'append', round(max(rest), 6), bool_and(fits) FROM g WHERE rest > 0 GROUP BY measure_key""")
def w20(spark, sf_dir):
    """What would be done to each event for the measure to come out right; nothing is changed."""
    e, m = seen(spark, sf_dir)
    p = ops.proposals(e.select("measure_key", "seq", "kind", "is_chord", "length"), m)
    return p.select("measure_key", "seq", "action", F.round(q.value(F.col("length")), 6).alias("quarters"), "fits")


@query("w20_repaired_lengths", PROPOSED + """ SELECT measure_key, round(sum(CASE WHEN main THEN cut ELSE 0 END) + max(rest), 6) AS quarters, round(max(expected), 6) AS expected FROM g GROUP BY measure_key HAVING bool_or(NOT ghost)""")
def w20_lengths(spark, sf_dir):
    """Lengths of measures after the proposals are carried out on request."""
    e, m = seen(spark, sf_dir)
    # computed by themselves: else their fractions are worked out anew for each use
    e = computed(e.where("kind in ('note', 'backup', 'forward')").select("measure_key", "seq", "kind", "is_chord", "is_rest", "length"))
    p = computed(ops.proposals(e, m))
    lead = F.array_min(F.collect_list(F.when(F.col("kind") == "note", F.col("seq"))))
    first = e.groupBy("measure_key").agg(lead.alias("lead"))
    done = ops.applied(e, p, opt_in=True).join(p.select("measure_key").distinct(), "measure_key", "left_semi").join(first, "measure_key")
    counted = F.collect_list(F.when((F.col("kind") == "note") & (~F.col("is_chord") | (F.col("seq") == F.col("lead"))), F.col("length")))
    return done.groupBy("measure_key").agg(q.total(counted).alias("t")).join(m, "measure_key").select("measure_key", F.round(q.value(F.col("t")), 6).alias("quarters"), F.round(q.value(F.col("expected")), 6).alias("expected"))


#: Heads that an image shows: pitched notes, every ninth a step too low; the bracket of a triplet spans what a slur does.
IMAGE = CARRIED + """, meter AS (SELECT *, beats * 4.0 / beat_type AS expected FROM carried),
n AS (SELECT n.*, divisions, expected, fifths, 7 * octave + position(step IN 'CDEFGAB') - 1 AS diatonic FROM notes n JOIN meter USING (measure_key) WHERE NOT is_grace),
spans AS (SELECT measure_key, min(CASE WHEN slur_start THEN x END) AS x1, max(CASE WHEN slur_stop THEN x END) AS x2 FROM notes GROUP BY measure_key),
heads AS (SELECT n.*, diatonic - CASE WHEN seq % 9 = 0 THEN 1 ELSE 0 END AS seen_at, duration >= 2 * divisions AS hollow, coalesce(x BETWEEN x1 - 10 AND x2 + 10, false) AS inside, x1 IS NOT NULL AND x2 IS NOT NULL AS bracket FROM n JOIN spans USING (measure_key) WHERE NOT is_rest)"""


def image(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate notes, heads, evidence) of the measures."""
    _, m = seen(spark, sf_dir)
    notes = core.notes(spark, sf_dir)
    spans = notes.groupBy("measure_key").agg(F.min(F.when(F.col("slur_start"), F.col("x"))).alias("x1"), F.max(F.when(F.col("slur_stop"), F.col("x"))).alias("x2"))
    span = F.struct(F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"))
    evidence = m.join(spans, "measure_key").select("measure_key", "divisions", "expected", "fifths", F.lit(100.0).alias("bottom"), F.lit(10.0).alias("interline"), F.when(F.col("x1").isNotNull() & F.col("x2").isNotNull(), F.array(span)).otherwise(F.array().cast("array<struct<x1:double,x2:double>>")).alias("spans"))
    own = notes.where("not is_grace").join(m.select("measure_key", "divisions"), "measure_key")
    candidates = own.select("measure_key", "seq", "step", F.col("octave").cast("long").alias("octave"), F.col("alter_by").cast("int").alias("alter_by"), "is_chord", (~F.col("is_rest")).alias("is_pitched"), F.col("duration").cast("long").alias("ticks"))
    at = 7 * F.col("octave") + F.instr(F.lit("CDEFGAB"), F.col("step")) - 1 - F.when(F.col("seq") % 9 == 0, 1).otherwise(0)
    heads = own.where("not is_rest").select("measure_key", F.col("x").cast("double").alias("x"), (100.0 - 5 * (at - 30)).alias("y"), (F.col("duration") >= 2 * F.col("divisions")).alias("hollow"), F.col("seq").alias("tie"))
    return candidates, heads, evidence


ALTERED = "CASE WHEN position(step IN left(CASE WHEN fifths > 0 THEN 'FCGDAEB' ELSE 'BEADGCF' END, abs(fifths)::INT)) > 0 AND fifths <> 0 THEN CASE WHEN fifths > 0 THEN 1 ELSE -1 END ELSE 0 END"


@query("d9_tuplet_gates", IMAGE + f""", t AS (SELECT measure_key, count(*) AS notes, bool_and(NOT is_rest AND NOT is_chord) AS plain, max(expected) AS expected, max(divisions) AS divisions FROM n GROUP BY measure_key),
h AS (SELECT measure_key, count(*) AS heads, count(*) FILTER (inside) AS n_in, bool_and(NOT inside OR (NOT hollow AND duration = divisions)) AS filled_in, bool_and(seen_at = diatonic AND alter_by = {ALTERED}) AS pitches, sum(CASE WHEN inside THEN 0 ELSE duration END) AS outside FROM heads GROUP BY measure_key),
g AS (SELECT t.*, s.x1 IS NOT NULL AND s.x2 IS NOT NULL AS one_bracket, plain AND coalesce(heads, 0) = notes AS as_many, h.* EXCLUDE (measure_key) FROM t JOIN spans s USING (measure_key) LEFT JOIN h USING (measure_key)),
r AS (SELECT *, coalesce(expected, 0) - CASE WHEN as_many THEN outside ELSE 0 END * 1.0 / divisions AS remaining FROM g)
SELECT measure_key, as_many, one_bracket, as_many AND n_in = 3 AND filled_in AS filled, as_many AND pitches AS pitches, round(remaining, 6) AS remaining, remaining = 2 AND (2 * divisions) % 3 = 0 AS exact, as_many AND n_in = 3 AND filled_in AND pitches AND remaining = 2 AND (2 * divisions) % 3 = 0 AS agrees FROM r""")
def d9(spark, sf_dir):
    g = ops.tuplet_gates(*image(spark, sf_dir))
    return g.select("measure_key", "as_many", "one_bracket", "filled", "pitches", F.round(q.value(F.col("remaining")), 6).alias("remaining"), "exact", "agrees")


@query("d10_head_proposals", IMAGE + """, c AS (SELECT measure_key, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out, bool_or(inside AND hollow) AS white_in, bool_and(inside OR hollow) AS white_out, coalesce(max(expected), 0) - 2 * count(*) FILTER (NOT inside) AS remaining FROM heads WHERE bracket GROUP BY measure_key)
SELECT measure_key, seq, seen_at, round(CASE WHEN inside THEN remaining / 3.0 ELSE 2 END, 6) AS quarters FROM heads JOIN c USING (measure_key) WHERE n_in = 3 AND n_out > 0 AND NOT white_in AND white_out AND remaining IN (1, 2)""")
def d10(spark, sf_dir):
    _, heads, evidence = image(spark, sf_dir)
    p = ops.image_proposals(heads, evidence)
    return p.select("measure_key", F.col("tie").alias("seq"), F.col("at").alias("seen_at"), F.round(q.value(F.col("quarters")), 6).alias("quarters"))


@query("d11_candidate_gates", IMAGE.replace("notes n JOIN meter", "notes n JOIN meter") + """, c AS (SELECT k.measure_key, count(*) AS notes, sum(CASE WHEN is_chord THEN 0 ELSE duration END) AS total, coalesce(max(m.divisions_given), 1) AS own, bool_and((duration * k.divisions) % coalesce(m.divisions_given, 1) = 0) AS exact
  FROM n k JOIN measures m USING (measure_key) WHERE NOT is_rest GROUP BY k.measure_key),
h AS (SELECT measure_key, count(*) AS heads FROM notes WHERE NOT is_rest GROUP BY measure_key),
v AS (SELECT score_id, line + 1 AS measure_idx, count(*) FILTER (regexp_matches(text, '\\p{L}')) AS words FROM tokens GROUP BY ALL),
x AS (SELECT measure_key, md5(string_agg(seq || kind || duration, ',' ORDER BY seq)) AS now, md5(coalesce(string_agg(seq || kind || duration, ',' ORDER BY seq) FILTER (NOT is_tuplet), '')) AS made FROM score_events GROUP BY measure_key),
g AS (SELECT measure_key, heads = notes AS heads_match, coalesce(words = notes, false) AS verses_match, coalesce(abs(total * 1.0 / own - expected) < 1e-9, false) AS beats_match, exact, now = made AS current FROM c JOIN meter USING (measure_key) JOIN h USING (measure_key) JOIN x USING (measure_key) LEFT JOIN v USING (score_id, measure_idx))
SELECT *, heads_match AND verses_match AND beats_match AND exact AND current AS verified FROM g""")
def d11(spark, sf_dir):
    """Notes of an engine that knows only the divisions written in a measure, against heads, words and the measure as it is."""
    e, m = seen(spark, sf_dir)
    line = lambda keep: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("seq", F.concat("seq", "kind", "duration").alias("t"))))), lambda x: x["t"]), ","))
    hashes = e.groupBy("measure_key").agg(line(F.lit(True)).alias("xml_sha256"), line(~F.col("is_tuplet")).alias("made"))
    given = core.measures(spark, sf_dir).select("score_id", "measure_key", "measure_idx", F.coalesce("divisions_given", F.lit(1)).alias("own"))
    notes = core.notes(spark, sf_dir)
    c = notes.where("not is_rest and not is_grace").select("measure_key", "seq", "is_chord", F.col("duration").alias("ticks")).join(given.select("measure_key", F.col("own").alias("divisions")), "measure_key").join(hashes.select("measure_key", F.col("made").alias("xml_sha256")), "measure_key")
    heads = notes.where("not is_rest").groupBy("measure_key").agg(F.count("*").alias("n"))
    words = core.tokens(spark, sf_dir).groupBy("score_id", (F.col("line") + 1).alias("measure_idx"), "verse").agg(F.count_if(F.col("text").rlike(r"\p{L}")).alias("n"))
    verses = given.join(words, ["score_id", "measure_idx"]).select("measure_key", "verse", "n")
    current = m.join(hashes.select("measure_key", "xml_sha256"), "measure_key")
    return ops.verified(c, heads, verses, current)


@query("r9_incremental_lengths", """, stepped2 AS (SELECT *, CASE kind WHEN 'note' THEN CASE WHEN is_chord OR is_grace THEN 0 ELSE duration END WHEN 'forward' THEN duration WHEN 'backup' THEN -duration ELSE 0 END AS step_by FROM score_events),
moved2 AS (SELECT *, sum(step_by) OVER (PARTITION BY measure_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cur FROM stepped2)
SELECT score_id, measure_key, CAST(greatest(max(CASE WHEN kind <> 'backup' THEN cur END), 0) AS BIGINT) AS length FROM moved2 GROUP BY ALL""")
def r9(spark, sf_dir):
    """Lengths of measures, built for a corpus in which one score in fifty was otherwise and some were missing, then brought up to date."""
    from ..operators import incremental
    from ..operators.shared import shared_path

    now = core.score_events(spark, sf_dir)
    s = F.col("score_id")
    before = now.where(s % 31 != 5).withColumn("duration", F.when(s % 50 == 7, F.col("duration") + 1).otherwise(F.col("duration")))
    build = lambda e: ms.with_cursor(e).groupBy("score_id", "measure_key").agg(F.greatest(F.max(F.when(F.col("kind") != "backup", F.col("cursor"))), F.lit(0)).cast("long").alias("length"))
    path = shared_path(spark, "lengths")
    incremental.update(spark, path, before, build, version="1")
    incremental.update(spark, path, now, build, version="1")
    return incremental.rows_of(spark, path, "measure_key").select("score_id", "measure_key", "length")
