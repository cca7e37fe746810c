"""Queries over measures and notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import measures as ops
from ..registry import query
from . import core

CARRIED = """, carried AS (
  SELECT score_id, part_id, measure_key, measure_idx, new_page, new_system, width,
    coalesce(last_value(divisions_given IGNORE NULLS) OVER w, 1) AS divisions, last_value(beats IGNORE NULLS) OVER w AS beats,
    last_value(beat_type IGNORE NULLS) OVER w AS beat_type, coalesce(last_value(fifths_given IGNORE NULLS) OVER w, 0) AS fifths
  FROM measures WINDOW w AS (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING))"""
CURSOR = """, stepped AS (
  SELECT *, CASE kind WHEN 'note' THEN CASE WHEN is_chord OR is_grace THEN 0 ELSE duration END WHEN 'forward' THEN duration WHEN 'backup' THEN -duration ELSE 0 END AS step_by FROM score_events),
moved AS (SELECT *, sum(step_by) OVER (PARTITION BY measure_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cur FROM stepped),
lengths AS (SELECT measure_key, greatest(max(CASE WHEN kind <> 'backup' THEN cur END), 0) AS length FROM moved GROUP BY measure_key)"""
RHYTHM = CARRIED + CURSOR + """, rhythm0 AS (
  SELECT c.*, coalesce(l.length, 0) / c.divisions AS actual, c.beats * 4.0 / c.beat_type AS expected FROM carried c LEFT JOIN lengths l USING (measure_key)),
rhythm AS (
  SELECT *, coalesce(first_value(actual) OVER w < first_value(expected) OVER w AND abs(first_value(actual) OVER w + last_value(actual) OVER w - first_value(expected) OVER w) < 0.001, false)
    AND (measure_idx = min(measure_idx) OVER w OR measure_idx = max(measure_idx) OVER w) AS pickup
  FROM rhythm0 WINDOW w AS (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
SUNG = """, pitched AS (
  SELECT *, first_value(voice) OVER (PARTITION BY measure_key, staff ORDER BY seq) AS prime FROM notes WHERE NOT is_rest AND NOT is_grace),
sung AS (SELECT *, 12 * (octave + 1) + CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + alter_by AS midi
  FROM pitched WHERE voice = prime AND NOT is_chord AND NOT tie_stop)"""


@query("w1_carry_forward", CARRIED + " SELECT measure_key, measure_idx, divisions, beats, beat_type, fifths FROM carried")
def w1(spark, sf_dir):
    return ops.carried(core.measures(spark, sf_dir)).select("measure_key", "measure_idx", "divisions", "beats", "beat_type", "fifths")


@query("a1_measure_length", CURSOR + " SELECT measure_key, CAST(length AS BIGINT) AS length FROM lengths")
def a1(spark, sf_dir):
    return ops.lengths(core.score_events(spark, sf_dir))


@query("q3_wrong_length", RHYTHM + " SELECT score_id, part_id, measure_key, measure_idx, actual, expected FROM rhythm WHERE expected > 0 AND abs(actual - expected) > 0.001 AND NOT pickup")
def q3(spark, sf_dir):
    return ops.wrong_length(core.measures(spark, sf_dir), core.score_events(spark, sf_dir)).select("score_id", "part_id", "measure_key", "measure_idx", "actual", "expected")


@query("q15_rhythm_issues", RHYTHM + """ SELECT 'rhythm-' || score_id || '-m' || measure_idx AS id, CASE WHEN actual < expected THEN 'underfull' ELSE 'overfull' END AS issue, actual, expected
  FROM rhythm WHERE expected > 0 AND abs(actual - expected) > 0.001""")
def q15(spark, sf_dir):
    r = ops.rhythm(core.measures(spark, sf_dir), core.score_events(spark, sf_dir)).where("expected > 0 and abs(actual - expected) > 0.001")
    return r.select(F.concat(F.lit("rhythm-"), "score_id", F.lit("-m"), "measure_idx").alias("id"), F.when(F.col("actual") < F.col("expected"), "underfull").otherwise("overfull").alias("issue"), "actual", "expected")


@query("w7_pickup", RHYTHM + " SELECT measure_key, pickup FROM rhythm WHERE pickup")
def w7(spark, sf_dir):
    return ops.rhythm(core.measures(spark, sf_dir), core.score_events(spark, sf_dir)).where("pickup").select("measure_key", "pickup")


@query("a2_voice_length", CARRIED + """ SELECT e.measure_key, e.voice, CAST(sum(e.duration) AS BIGINT) AS total, c.beats * c.divisions AS wanted
  FROM score_events e JOIN carried c USING (measure_key) WHERE kind = 'note' AND NOT is_chord AND NOT is_grace AND e.measure_idx > 1
  GROUP BY ALL HAVING sum(e.duration) <> c.beats * c.divisions""")
def a2(spark, sf_dir):
    v = ops.voice_lengths(core.score_events(spark, sf_dir).where("measure_idx > 1"))
    c = ops.carried(core.measures(spark, sf_dir)).select("measure_key", (F.col("beats") * F.col("divisions")).alias("wanted"))
    return v.join(c, "measure_key").where("total <> wanted").select("measure_key", "voice", "total", "wanted")


@query("w3_layout", """, flags AS (SELECT *, row_number() OVER p = 1 AS is_first FROM measures WINDOW p AS (PARTITION BY score_id, part_id ORDER BY measure_idx)),
paged AS (SELECT *, 1 + sum(CASE WHEN new_page AND NOT is_first THEN 1 ELSE 0 END) OVER u AS page, 1 + sum(CASE WHEN (new_page OR new_system) AND NOT is_first THEN 1 ELSE 0 END) OVER u AS system
  FROM flags WINDOW u AS (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING))
SELECT measure_key, CAST(page AS BIGINT) AS page, CAST(system AS BIGINT) AS system, coalesce(sum(coalesce(CAST(width AS DOUBLE), 100.0)) OVER (PARTITION BY score_id, part_id, system ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "offset" FROM paged""")
def w3(spark, sf_dir):
    return ops.layout(core.measures(spark, sf_dir)).select("measure_key", "page", "system", "offset")


@query("w2_renumber", """, flags AS (SELECT *, row_number() OVER p = 1 AS is_first FROM measures WINDOW p AS (PARTITION BY score_id, part_id ORDER BY measure_idx)),
paged AS (SELECT *, 1 + sum(CASE WHEN new_page AND NOT is_first THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS page FROM flags)
SELECT measure_key, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY score_id, part_id ORDER BY measure_idx) AS number, row_number() OVER (PARTITION BY score_id, part_id, page ORDER BY measure_idx) AS local_number FROM paged""")
def w2(spark, sf_dir):
    return ops.renumbered(core.measures(spark, sf_dir)).select("measure_key", "page", "number", "local_number")


@query("p1_eligible_notes", " SELECT measure_key, note_index FROM notes WHERE NOT is_rest AND NOT is_chord AND NOT is_grace AND NOT (tie_stop AND NOT tie_start)")
def p1(spark, sf_dir):
    return core.notes(spark, sf_dir).where(ops.eligible()).select("measure_key", "note_index")


@query("p2_lyric_capable_ordinal", " SELECT measure_key, note_index, row_number() OVER (PARTITION BY measure_key ORDER BY seq) AS ordinal FROM notes WHERE NOT is_rest AND NOT is_chord")
def p2(spark, sf_dir):
    from pyspark.sql import Window

    n = core.notes(spark, sf_dir).where("not is_rest and not is_chord")
    return n.select("measure_key", "note_index", F.row_number().over(Window.partitionBy("measure_key").orderBy("seq")).cast("long").alias("ordinal"))


@query("a4_note_counts", SUNG + """, slurred AS (
  SELECT *, coalesce(last_value(CASE WHEN slur_start THEN 1 WHEN slur_stop THEN 0 END IGNORE NULLS) OVER (PARTITION BY measure_key, staff ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM sung),
s AS (SELECT measure_key, staff, count(*) AS sung_notes, sum(open) AS melisma FROM slurred GROUP BY ALL),
a AS (SELECT measure_key, staff, count(*) FILTER (NOT is_rest AND NOT is_grace) AS notes, count(*) FILTER (is_tuplet) AS tuplets FROM notes GROUP BY ALL)
SELECT measure_key, staff, notes, tuplets, coalesce(sung_notes, 0) AS sung_notes, CAST(coalesce(melisma, 0) AS BIGINT) AS melisma FROM a LEFT JOIN s USING (measure_key, staff)""")
def a4(spark, sf_dir):
    return ops.note_counts(core.notes(spark, sf_dir)).select("measure_key", "staff", "notes", "tuplets", "sung_notes", F.col("melisma").cast("long").alias("melisma"))


@query("w6_leaps", SUNG + """, led AS (SELECT *, lead(midi, 1) OVER w AS n1, lead(midi, 2) OVER w AS n2 FROM sung WINDOW w AS (PARTITION BY measure_key, staff ORDER BY seq))
SELECT measure_key, staff, seq, midi, midi < 57 OR midi > 81 AS out_of_range, coalesce(abs(n1 - midi) > 12 AND abs(n2 - midi) <= 2, false) AS leap FROM led
WHERE midi < 57 OR midi > 81 OR coalesce(abs(n1 - midi) > 12 AND abs(n2 - midi) <= 2, false)""")
def w6(spark, sf_dir):
    return ops.leaps(core.notes(spark, sf_dir)).select("measure_key", "staff", "seq", "midi", "out_of_range", "leap")


@query("w17_onsets", CARRIED + CURSOR + """, placed AS (
  SELECT m.measure_key, seq, kind, divisions, CASE WHEN kind = 'note' AND is_chord THEN coalesce(last_value(CASE WHEN kind = 'note' AND NOT is_chord AND NOT is_grace THEN cur - step_by END IGNORE NULLS)
    OVER (PARTITION BY m.measure_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE cur - step_by END + CASE WHEN kind = 'harmony' AND duration = 3 THEN seq ELSE 0 END AS ticks
  FROM moved m JOIN carried c ON m.measure_key = c.measure_key)
SELECT measure_key, seq, kind, CAST(ticks / gcd(abs(CAST(ticks AS BIGINT)), divisions) AS BIGINT) AS num, CAST(divisions / gcd(abs(CAST(ticks AS BIGINT)), divisions) AS BIGINT) AS den FROM placed WHERE kind IN ('note', 'harmony')""")
def w17(spark, sf_dir):
    """Harmonies of three ticks have an offset, as many ticks as their place in the measure."""
    e = core.score_events(spark, sf_dir)
    return ops.onsets(core.measures(spark, sf_dir), e.withColumn("offset_ticks", F.when((F.col("kind") == "harmony") & (F.col("duration") == 3), F.col("seq"))))


@query("w20_duration_repair", RHYTHM + """ SELECT measure_key, score_id, measure_idx, CASE WHEN expected > actual THEN 'pad' ELSE 'trim' END AS action,
  (SELECT v FROM (VALUES (0.25), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0), (4.0), (6.0), (8.0)) t(v) ORDER BY abs(abs(expected - actual) - v), v LIMIT 1)::DOUBLE AS amount
  FROM rhythm WHERE expected > 0 AND abs(actual - expected) > 0.001""")
def w20(spark, sf_dir):
    return ops.repaired(core.measures(spark, sf_dir), core.score_events(spark, sf_dir))


@query("p6_midi_pitch", " SELECT measure_key, seq, 12 * (octave + 1) + CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + alter_by AS midi FROM notes WHERE NOT is_rest")
def p6(spark, sf_dir):
    return core.notes(spark, sf_dir).where("not is_rest").select("measure_key", "seq", music.midi_pitch(F.col("step"), F.col("octave"), F.col("alter_by")).alias("midi"))


@query("p8_transpose", """, moved AS (SELECT measure_key, seq, 12 * (octave + 1) + CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + alter_by + 5 AS midi FROM notes WHERE NOT is_rest)
SELECT measure_key, seq, left(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1], 1) AS step, length(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1]) - 1 AS alter_by, midi // 12 - 1 AS octave FROM moved""")
def p8(spark, sf_dir):
    n = core.notes(spark, sf_dir).where("not is_rest")
    t = music.transposed(F.col("step"), F.col("octave"), F.col("alter_by"), 5)
    return n.select("measure_key", "seq", t.alias("t")).select("measure_key", "seq", "t.step", F.col("t.alter").alias("alter_by"), F.col("t.octave").alias("octave"))


@query("p15_out_of_key", CARRIED + """ SELECT e.measure_key, e.seq, e.step, e.alter_by, c.fifths FROM score_events e JOIN carried c USING (measure_key)
  WHERE kind = 'harmony' AND ((CASE step WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + alter_by - 7 * fifths) % 12 + 12) % 12 NOT IN (0,2,4,5,7,9,11,3,8,10)""")
def p15(spark, sf_dir):
    e = core.score_events(spark, sf_dir).where("kind = 'harmony'").join(ops.carried(core.measures(spark, sf_dir)).select("measure_key", "fifths"), "measure_key")
    return e.where(~music.in_key(F.col("step"), F.col("alter_by"), F.col("fifths"))).select("measure_key", "seq", "step", "alter_by", "fifths")


@query("p16_key_accidentals", CARRIED + """ SELECT n.measure_key, n.seq, CASE WHEN fifths > 0 AND instr('FCGDAEB', step) <= fifths THEN 1 WHEN fifths < 0 AND instr('BEADGCF', step) <= -fifths THEN -1 ELSE 0 END AS key_alter
  FROM notes n JOIN carried c USING (measure_key)""")
def p16(spark, sf_dir):
    n = core.notes(spark, sf_dir).join(ops.carried(core.measures(spark, sf_dir)).select("measure_key", "fifths"), "measure_key")
    return n.select("measure_key", "seq", music.key_alteration(F.col("step"), F.col("fifths")).alias("key_alter"))


@query("a7_score_summary", """ SELECT e.score_id, count(DISTINCT e.part_id) AS parts, count(DISTINCT e.measure_key) AS n_measures, count(*) FILTER (kind = 'note' AND NOT is_rest) AS pitched,
  count(*) FILTER (kind = 'note' AND is_rest) AS rests, count(*) FILTER (kind = 'note' AND is_tuplet) AS tuplets FROM score_events e GROUP BY e.score_id""")
def a7(spark, sf_dir):
    note = F.col("kind") == "note"
    return core.score_events(spark, sf_dir).groupBy("score_id").agg(F.countDistinct("part_id").alias("parts"), F.countDistinct("measure_key").alias("n_measures"), F.count_if(note & ~F.col("is_rest")).alias("pitched"), F.count_if(note & F.col("is_rest")).alias("rests"), F.count_if(note & F.col("is_tuplet")).alias("tuplets"))


@query("q16_note_sanity", " SELECT measure_key, seq, CASE WHEN octave NOT BETWEEN 0 AND 9 THEN 'octave' WHEN duration <= 0 AND NOT is_grace THEN 'duration' WHEN is_rest AND is_chord THEN 'rest_in_chord' END AS issue FROM notes WHERE octave NOT BETWEEN 0 AND 9 OR (duration <= 0 AND NOT is_grace) OR (is_rest AND is_chord)")
def q16(spark, sf_dir):
    bad_octave, bad_length, bad_rest = ~F.col("octave").between(0, 9), (F.col("duration") <= 0) & ~F.col("is_grace"), F.col("is_rest") & F.col("is_chord")
    n = core.notes(spark, sf_dir).where(bad_octave | bad_length | bad_rest)
    return n.select("measure_key", "seq", F.when(bad_octave, "octave").when(bad_length, "duration").when(bad_rest, "rest_in_chord").alias("issue"))


@query("p4_note_locator", """, v AS (SELECT *, row_number() OVER (PARTITION BY measure_key, staff, voice ORDER BY seq) AS ordinal FROM notes WHERE NOT is_chord)
SELECT part_id || ':M' || measure_idx || ':S' || staff || ':V' || voice || ':N' || ordinal AS locator, measure_key, seq FROM v""")
def p4(spark, sf_dir):
    from pyspark.sql import Window

    n = core.notes(spark, sf_dir).where("not is_chord").withColumn("ordinal", F.row_number().over(Window.partitionBy("measure_key", "staff", "voice").orderBy("seq")))
    return n.select(F.concat("part_id", F.lit(":M"), "measure_idx", F.lit(":S"), "staff", F.lit(":V"), "voice", F.lit(":N"), "ordinal").alias("locator"), "measure_key", "seq")


@query("p7_expected_beats", """, t AS (SELECT measure_key, CASE measure_key % 4 WHEN 0 THEN '3+2' WHEN 1 THEN '2+2+3' WHEN 2 THEN '4' ELSE '6' END AS beats, CASE WHEN measure_key % 2 = 0 THEN 4 ELSE 8 END AS beat_type FROM measures)
SELECT measure_key, list_sum(list_transform(string_split(beats, '+'), lambda x: CAST(x AS DOUBLE))) * 4 / beat_type AS expected FROM t""")
def p7(spark, sf_dir):
    """Additive meters add up."""
    k = F.col("measure_key")
    beats = F.when(k % 4 == 0, "3+2").when(k % 4 == 1, "2+2+3").when(k % 4 == 2, "4").otherwise("6")
    return core.measures(spark, sf_dir).select("measure_key", music.expected_beats(beats, F.when(k % 2 == 0, 4).otherwise(8)).alias("expected"))


@query("w4_slur_state", """, s AS (SELECT measure_key, seq, coalesce(last_value(CASE WHEN slur_start THEN 1 WHEN slur_stop THEN 0 END IGNORE NULLS) OVER (PARTITION BY measure_key, staff ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(slur_start::INT) OVER (PARTITION BY measure_key, staff ORDER BY seq ROWS UNBOUNDED PRECEDING) - coalesce(sum(slur_stop::INT) OVER (PARTITION BY measure_key, staff ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open, slur_start FROM notes)
SELECT measure_key, seq, before = 1 AS melisma, open > 0 AS inside, open > 0 AND NOT slur_start AS continued FROM s""")
def w4(spark, sf_dir):
    """Both readings: the ledger's (one state, before this note's signs) and the aligner's (starts count at once, stops after the note)."""
    from pyspark.sql import Window

    w = Window.partitionBy("measure_key", "staff").orderBy("seq")
    n = ops.in_slur(core.notes(spark, sf_dir))
    stopped = F.coalesce(F.sum(F.col("slur_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(F.col("slur_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) > stopped
    return n.select("measure_key", "seq", (F.col("slurred") == 1).alias("melisma"), inside.alias("inside"), (inside & ~F.col("slur_start")).alias("continued"))


#: A part for each staff; a part is on the pages where it has events. A first measure that is short is a pickup with the number 0.
PART_PAGES = CARRIED + """, flags AS (SELECT *, row_number() OVER p = 1 AS is_first FROM measures WINDOW p AS (PARTITION BY score_id ORDER BY measure_idx)),
pages AS (SELECT *, 1 + sum(CASE WHEN new_page AND NOT is_first THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS page FROM flags),
starts AS (SELECT score_id, page, min(measure_idx) AS start FROM pages GROUP BY ALL),
entries AS (SELECT DISTINCT p.score_id, 'P' || e.staff AS part_id, p.measure_key, p.measure_idx, page, p.measure_idx - start + 1 AS local_number, p.beats * 4.0 / p.beat_type AS expected_given, p.score_id % 2 AS pickup
  FROM pages p JOIN starts USING (score_id, page) JOIN score_events e USING (measure_key))"""


@query("w2_merged_numbers", PART_PAGES + """, f AS (SELECT *, count(*) FILTER (page > 1) OVER (PARTITION BY score_id, part_id ORDER BY measure_idx) AS later, max(CASE WHEN page = 1 THEN local_number - pickup END) OVER (PARTITION BY score_id, part_id) AS base FROM entries)
SELECT measure_key, part_id, page, CASE WHEN page = 1 THEN local_number - pickup ELSE coalesce(base, 0) + later END AS number, last_value(expected_given IGNORE NULLS) OVER (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS expected FROM f""")
def w2_merged(spark, sf_dir):
    """Measures of each part numbered through its pages; scores of odd number begin with a pickup, 0."""
    m = ops.layout(core.measures(spark, sf_dir)).withColumn("start", F.min("measure_idx").over(Window.partitionBy("score_id", "page")))
    parts = core.score_events(spark, sf_dir).select("measure_key", F.concat(F.lit("P"), "staff").alias("part_id")).distinct()
    local = F.col("measure_idx") - F.col("start") + 1
    e = m.drop("part_id").join(parts, "measure_key").select("score_id", "part_id", "measure_key", "page", F.col("measure_idx").alias("nth"), local.alias("local_number"), (local - F.col("score_id") % 2).alias("own_number"), music.expected_beats(F.col("beats"), F.col("beat_type")).alias("expected_given"))
    return ops.merged(e).select("measure_key", "part_id", "page", "number", "expected")


@query("w3_staff_rows", """, flags AS (SELECT *, 1 + sum(CASE WHEN new_page THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS page FROM measures),
systems AS (SELECT *, sum(CASE WHEN new_system AND NOT new_page THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, page ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS system FROM flags),
lefts AS (SELECT *, coalesce(sum(coalesce(width, 100)) OVER (PARTITION BY score_id, page, system ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM systems),
n AS (SELECT score_id, measure_key, seq, voice AS part_idx, staff, x FROM notes), staves AS (SELECT score_id, part_idx, max(staff) AS staves FROM n GROUP BY ALL),
s AS (SELECT *, coalesce(sum(staves) OVER (PARTITION BY score_id ORDER BY part_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(staves) OVER (PARTITION BY score_id) AS all_ FROM staves)
SELECT measure_key, seq, page, system, CAST(system * all_ + before + staff - 1 AS BIGINT) AS row, left_ + x AS x FROM n JOIN lefts USING (score_id, measure_key) JOIN s USING (score_id, part_idx)""")
def w3_rows(spark, sf_dir):
    """Staff rows of notes; each voice is a part with its own staves."""
    n = core.notes(spark, sf_dir).select("score_id", F.concat(F.lit("P"), "voice").alias("part_id"), F.col("voice").alias("part_idx"), "measure_key", "measure_idx", "seq", "staff", F.col("x").alias("local_x"))
    m = core.measures(spark, sf_dir).select("score_id", F.explode(F.array(F.lit("P1"), F.lit("P2"))).alias("part_id"), "measure_idx", "new_page", "new_system", "width")
    return ops.staff_rows(n, m).select("measure_key", "seq", "page", "system", F.col("row").cast("long").alias("row"), "x")
