"""Queries over the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as ops
from ..registry import query
from . import core
from .measures import SUNG


@query("j1_positional_zip", """, h AS (SELECT measure_key, seq AS head, row_number() OVER (PARTITION BY measure_key ORDER BY x, seq) AS ordinal FROM score_events WHERE kind = 'note' AND voice = 1 AND NOT is_rest),
n AS (SELECT measure_key, seq AS note, row_number() OVER (PARTITION BY measure_key ORDER BY seq) AS ordinal FROM score_events WHERE kind = 'note' AND voice = 1 AND NOT is_chord),
j AS (SELECT coalesce(h.measure_key, n.measure_key) AS measure_key, head, note, coalesce(h.ordinal, n.ordinal) AS ordinal FROM h FULL JOIN n ON h.measure_key = n.measure_key AND h.ordinal = n.ordinal)
SELECT measure_key, ordinal, head, note, bool_and(head IS NOT NULL AND note IS NOT NULL) OVER (PARTITION BY measure_key) AS complete FROM j""")
def j1(spark, sf_dir):
    e = core.score_events(spark, sf_dir).where("kind = 'note' and voice = 1")
    heads = e.where("not is_rest").select("measure_key", F.col("seq").alias("head"), "x")
    notes = e.where("not is_chord").select("measure_key", F.col("seq").alias("note"))
    return ops.positional(heads, notes, ["measure_key"], ["x", "head"], ["note"]).select("measure_key", "ordinal", "head", "note", "complete")


@query("j5_nearest_anchor", """, c AS (SELECT measure_key, seq, x FROM score_events WHERE kind = 'harmony'), o AS (
  SELECT c.measure_key, c.seq, abs(c.x - n.x) AS distance, n.note_index, row_number() OVER (PARTITION BY c.measure_key, c.seq ORDER BY abs(c.x - n.x), n.note_index) AS r FROM c JOIN notes n ON c.measure_key = n.measure_key WHERE NOT n.is_rest)
SELECT measure_key, seq, distance, note_index FROM o WHERE r = 1""")
def j5(spark, sf_dir):
    chords = core.score_events(spark, sf_dir).where("kind = 'harmony'").select("measure_key", "seq", F.col("x").alias("cx"))
    anchors = core.notes(spark, sf_dir).where("not is_rest").select("measure_key", "note_index", F.col("x").alias("ax"))
    return ops.nearest(chords, anchors, ["measure_key"], ["measure_key", "seq"], "cx", "ax", ["note_index"], "note_index")


@query("j6_asof_interpolation", """, a AS (SELECT measure_key, x, 4.0 * note_index AS onset FROM notes WHERE NOT is_rest AND NOT is_chord), c AS (SELECT measure_key, seq, x FROM score_events WHERE kind = 'harmony'),
b AS (SELECT c.*, p.x AS x0, p.onset AS v0, q.x AS x1, q.onset AS v1 FROM c ASOF LEFT JOIN a p ON c.measure_key = p.measure_key AND c.x >= p.x ASOF LEFT JOIN a q ON c.measure_key = q.measure_key AND c.x <= q.x)
SELECT measure_key, seq, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 WHEN x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (x - x0) / (x1 - x0) END AS value FROM b""")
def j6(spark, sf_dir):
    chords = core.score_events(spark, sf_dir).where("kind = 'harmony'").select("measure_key", "seq", "x")
    anchors = core.notes(spark, sf_dir).where("not is_rest and not is_chord").select("measure_key", "x", (4.0 * F.col("note_index")).alias("onset"))
    return ops.interpolated(chords, anchors, ["measure_key"], "x", "onset", "seq")


@query("j2_words_in_measure", """, spans AS (SELECT measure_key, score_id, measure_idx, 20.0 * measure_idx AS x1, 20.0 * measure_idx + 20 AS x2 FROM measures)
SELECT t.score_id, t.pos, s.measure_key FROM tokens t JOIN spans s ON t.score_id = s.score_id AND t.x >= s.x1 AND t.x < s.x2""")
def j2(spark, sf_dir):
    spans = core.measures(spark, sf_dir).select("score_id", "measure_key", (20.0 * F.col("measure_idx")).alias("x1"), (20.0 * F.col("measure_idx") + 20).alias("x2"))
    return ops.contained(core.tokens(spark, sf_dir), spans, ["score_id"], "x", "x1", "x2", 20.0).select("score_id", "pos", "measure_key")


@query("j18_upsert_edits", """, base AS (SELECT measure_key, note_index, step, octave FROM notes WHERE NOT is_rest), edits AS (SELECT DISTINCT measure_key, note_index + note_index % 2 AS note_index, 'C' AS step, 4 AS octave FROM notes WHERE duration = 4)
SELECT coalesce(b.measure_key, e.measure_key) AS measure_key, coalesce(b.note_index, e.note_index) AS note_index, coalesce(e.step, b.step) AS step, coalesce(e.octave, b.octave) AS octave FROM base b FULL JOIN edits e ON b.measure_key = e.measure_key AND b.note_index = e.note_index""")
def j18(spark, sf_dir):
    n = core.notes(spark, sf_dir)
    base = n.where("not is_rest").select("measure_key", "note_index", "step", "octave")
    edits = n.where("duration = 4").select("measure_key", (F.col("note_index") + F.col("note_index") % 2).alias("note_index"), F.lit("C").alias("step"), F.lit(4).cast("long").alias("octave")).distinct()
    return ops.upserted(base, edits, ["measure_key", "note_index"], ["step", "octave"])


@query("j20_issue_merge", """, a AS (SELECT measure_key, 'rhythm' AS kind, 'ours' AS origin FROM measures WHERE measure_key % 3 = 0), b AS (SELECT measure_key, 'rhythm' AS kind, 'theirs' AS origin FROM measures WHERE measure_key % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.measure_key = b.measure_key AND a.kind = b.kind)""")
def j20(spark, sf_dir):
    k = core.measures(spark, sf_dir).select("measure_key", F.lit("rhythm").alias("kind"))
    return ops.filled(k.where("measure_key % 3 = 0").withColumn("origin", F.lit("ours")), k.where("measure_key % 2 = 0").withColumn("origin", F.lit("theirs")), ["measure_key", "kind"])


@query("j21_library_sync", """, l AS (SELECT score_id, title, book FROM scores WHERE score_id % 5 <> 0), r AS (SELECT score_id, CASE WHEN score_id % 7 = 0 THEN title || '!' ELSE title END AS title, book FROM scores WHERE score_id % 3 <> 0)
SELECT coalesce(l.score_id, r.score_id) AS score_id, CASE WHEN l.score_id IS NULL THEN 'insert' WHEN r.score_id IS NULL THEN 'delete' WHEN l.title <> r.title OR l.book <> r.book THEN 'update' ELSE 'keep' END AS action FROM l FULL JOIN r ON l.score_id = r.score_id""")
def j21(spark, sf_dir):
    s = core.scores(spark, sf_dir)
    remote = s.where("score_id % 3 <> 0").withColumn("title", F.when(F.col("score_id") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return ops.synced(s.where("score_id % 5 <> 0"), remote, "score_id", ["title", "book"])


@query("j23_chorus_duplication", """, v AS (SELECT score_id, max(verse) AS top FROM tokens GROUP BY score_id), c AS (SELECT score_id, pos, text FROM tokens WHERE verse = 1 AND line % 4 = 0),
have AS (SELECT DISTINCT score_id, verse FROM tokens WHERE line % 4 = 0 AND line > 8)
SELECT c.score_id, c.pos, CAST(k AS BIGINT) AS verse, c.text FROM c JOIN v USING (score_id), generate_series(2, 3) g(k) WHERE k <= top AND NOT EXISTS (SELECT 1 FROM have h WHERE h.score_id = c.score_id AND h.verse = k)""")
def j23(spark, sf_dir):
    t = core.tokens(spark, sf_dir)
    top = t.groupBy("score_id").agg(F.max("verse").alias("top"))
    chorus = t.where("verse = 1 and line % 4 = 0").select("score_id", "pos", "text").join(top, "score_id").where("top >= 2")
    copies = chorus.select("score_id", "pos", F.explode(F.sequence(F.lit(2).cast("long"), F.col("top"))).alias("verse"), "text")
    return copies.join(t.where("line % 4 = 0 and line > 8").select("score_id", "verse").distinct(), ["score_id", "verse"], "left_anti").select("score_id", "pos", "verse", "text")


@query("j28_equality_gate", """, a AS (SELECT measure_key, note_index, step, octave, duration, voice FROM notes), b AS (SELECT measure_key, note_index, CASE WHEN measure_key % 6 = 0 AND note_index = 2 THEN 'C' ELSE step END AS step, octave, duration, voice FROM notes WHERE NOT (measure_key % 10 = 1 AND note_index = 3))
SELECT measure_key, bool_and(a.step IS NOT DISTINCT FROM b.step AND a.octave IS NOT DISTINCT FROM b.octave AND a.duration IS NOT DISTINCT FROM b.duration AND a.voice IS NOT DISTINCT FROM b.voice) AS equal FROM a FULL JOIN b USING (measure_key, note_index) GROUP BY measure_key""")
def j28(spark, sf_dir):
    n = core.notes(spark, sf_dir)
    cols = ["step", "octave", "duration", "voice"]
    a = n.select("measure_key", "note_index", F.struct(*cols).alias("mine"))
    b = n.where("not (measure_key % 10 = 1 and note_index = 3)").withColumn("step", F.when((F.col("measure_key") % 6 == 0) & (F.col("note_index") == 2), "C").otherwise(F.col("step"))).select("measure_key", "note_index", F.struct(*cols).alias("theirs"))
    return a.join(b, ["measure_key", "note_index"], "full").groupBy("measure_key").agg(F.bool_and(F.col("mine").eqNullSafe(F.col("theirs"))).alias("equal"))


@query("j30_sequential_lyrics", """, w AS (SELECT score_id, verse, text, row_number() OVER (PARTITION BY score_id, verse ORDER BY pos) AS ordinal FROM tokens WHERE trim(text) <> ''),
n AS (SELECT score_id, measure_key, note_index, row_number() OVER (PARTITION BY score_id ORDER BY measure_idx, seq) AS ordinal FROM notes WHERE NOT is_rest AND NOT is_chord)
SELECT w.score_id, w.verse, w.ordinal, w.text, n.measure_key, n.note_index FROM w JOIN n USING (score_id, ordinal)""")
def j30(spark, sf_dir):
    w = core.tokens(spark, sf_dir).where(F.trim("text") != "").withColumn("ordinal", F.row_number().over(Window.partitionBy("score_id", "verse").orderBy("pos")))
    n = core.notes(spark, sf_dir).where("not is_rest and not is_chord").withColumn("ordinal", F.row_number().over(Window.partitionBy("score_id").orderBy("measure_idx", "seq")))
    return w.select("score_id", "verse", "ordinal", "text").join(n.select("score_id", "ordinal", "measure_key", "note_index"), ["score_id", "ordinal"])


@query("j32_heads_in_bars", """, bars AS (SELECT measure_key, seq, x, lead(x) OVER (PARTITION BY measure_key ORDER BY x, seq) AS next_x FROM score_events WHERE kind IN ('backup', 'forward', 'harmony'))
SELECT n.measure_key, n.note_index, b.seq AS bar FROM notes n JOIN bars b ON n.measure_key = b.measure_key AND n.x >= b.x AND (b.next_x IS NULL OR n.x < b.next_x)""")
def j32(spark, sf_dir):
    e = core.score_events(spark, sf_dir).where("kind in ('backup', 'forward', 'harmony')")
    bars = e.select("measure_key", F.col("seq").alias("bar"), F.col("x").alias("x1"), F.coalesce(F.lead("x").over(Window.partitionBy("measure_key").orderBy("x", "seq")), F.lit(1e18)).alias("x2"))
    return ops.contained(core.notes(spark, sf_dir), bars, ["measure_key"], "x", "x1", "x2").select("measure_key", "note_index", "bar")


@query("j13_protected_bands", """, boxes AS (SELECT score_id, pos, line, x, confidence FROM tokens), bands AS (SELECT score_id, measure_idx AS band, measure_idx * 12 AS y1, measure_idx * 12 + 6 AS y2 FROM measures)
SELECT score_id, pos FROM boxes b WHERE EXISTS (SELECT 1 FROM bands k WHERE k.score_id = b.score_id AND b.x >= k.y1 - 2 AND b.x < k.y2 + 2)""")
def j13(spark, sf_dir):
    bands = core.measures(spark, sf_dir).select("score_id", (F.col("measure_idx") * 12 - 2).alias("y1"), (F.col("measure_idx") * 12 + 8).alias("y2"))
    return ops.contained(core.tokens(spark, sf_dir), bands, ["score_id"], "x", "y1", "y2", 10.0, "left_semi").select("score_id", "pos")


@query("u1_chord_f1", """, a AS (SELECT score_id, step, alter_by, duration, count(*) AS n FROM score_events WHERE kind = 'harmony' GROUP BY ALL),
b AS (SELECT score_id, step, CASE WHEN seq % 5 = 0 THEN 1 ELSE alter_by END AS alter_by, duration, count(*) AS n FROM score_events WHERE kind = 'harmony' AND seq % 6 <> 0 GROUP BY ALL),
j AS (SELECT score_id, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2 FROM a FULL JOIN b USING (score_id, step, alter_by, duration))
SELECT score_id, CAST(sum(n1) AS BIGINT) AS expected, CAST(sum(n2) AS BIGINT) AS actual, CAST(sum(least(n1, n2)) AS BIGINT) AS common, 2 * sum(least(n1, n2)) / nullif(sum(n1) + sum(n2), 0) AS f1 FROM j GROUP BY score_id""")
def u1(spark, sf_dir):
    h = core.score_events(spark, sf_dir).where("kind = 'harmony'")
    b = h.where("seq % 6 <> 0").withColumn("alter_by", F.when(F.col("seq") % 5 == 0, 1).otherwise(F.col("alter_by")))
    o = ops.multiset_overlap(h, b, ["score_id"], ["step", "alter_by", "duration"])
    return o.withColumn("f1", ops.f1(F.col("common"), F.col("expected"), F.col("actual")))


@query("u3_label_set_equality", """, a AS (SELECT DISTINCT score_id FROM tokens), b AS (SELECT DISTINCT doc_id AS score_id FROM labels)
SELECT count(*) FILTER (a.score_id IS NULL) AS only_labels, count(*) FILTER (b.score_id IS NULL) AS only_scores, count(*) FILTER (a.score_id IS NULL OR b.score_id IS NULL) = 0 AS complete FROM a FULL JOIN b ON a.score_id = b.score_id""")
def u3(spark, sf_dir):
    a = core.table(spark, sf_dir, "documents").where("text is not null").select("doc_id").distinct().withColumn("a", F.lit(True))
    b = core.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("b", F.lit(True))
    j = a.join(b, "doc_id", "full")
    return j.agg(F.count_if(F.col("a").isNull()).alias("only_labels"), F.count_if(F.col("b").isNull()).alias("only_scores"), (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("complete"))


@query("u4_missing_verses", " SELECT score_id, array_to_string(list_filter(range(1, max(verse) + 1), lambda v: NOT list_contains(list_distinct(list(verse)), v)), ',') AS missing FROM tokens GROUP BY score_id")
def u4(spark, sf_dir):
    t = core.tokens(spark, sf_dir).groupBy("score_id").agg(F.collect_set("verse").alias("have"), F.max("verse").alias("top"))
    return t.select("score_id", F.array_join(F.array_except(F.sequence(F.lit(1).cast("long"), "top"), "have"), ",").alias("missing"))


@query("u4_missing_elements", """, have AS (SELECT s.score_id, list_filter(['part-list', 'part', 'attributes'], lambda e: NOT list_contains([CASE WHEN m.n > 0 THEN 'part' END, CASE WHEN m.timed > 0 THEN 'attributes' END, CASE WHEN s.score_id % 7 <> 0 THEN 'part-list' END], e)) AS missing FROM scores s LEFT JOIN (SELECT score_id, count(*) AS n, count(beats) AS timed FROM measures GROUP BY ALL) m USING (score_id))
SELECT score_id, array_to_string(missing, ',') AS missing FROM have WHERE len(missing) > 0""")
def u4_elements(spark, sf_dir):
    """Required elements that a score lacks."""
    m = core.measures(spark, sf_dir).groupBy("score_id").agg(F.count("*").alias("n"), F.count("beats").alias("timed"))
    have = F.array_compact(F.array(F.when(F.col("n") > 0, "part"), F.when(F.col("timed") > 0, "attributes"), F.when(F.col("score_id") % 7 != 0, "part-list")))
    missing = F.array_except(F.array(*[F.lit(x) for x in ("part-list", "part", "attributes")]), have)
    return core.scores(spark, sf_dir).join(m, "score_id", "left").select("score_id", missing.alias("m")).where(F.size("m") > 0).select("score_id", F.array_join("m", ",").alias("missing"))


@query("a9_chord_suggestion", SUNG + """, w AS (SELECT measure_key, step, sum(CASE WHEN note_index = 1 THEN 3.0 ELSE 1.5 END * CASE WHEN duration >= 3 THEN 2 WHEN duration = 2 THEN 1 ELSE 0.5 END) AS weight FROM notes WHERE NOT is_rest GROUP BY ALL),
chords(ord, chord, steps) AS (VALUES (1,'C','CEG'),(2,'Dm','DFA'),(3,'Em','EGB'),(4,'F','FAC'),(5,'G','GBD'),(6,'G7','GBDF'),(7,'Am','ACE'),(8,'Bdim','BDF'),(9,'D','DFA'),(10,'D7','DFAC'),(11,'Bm','BDF'),(12,'B7','BDFA'),(13,'G/B','BGD'),(14,'D/F#','FDA')),
t AS (SELECT measure_key, ord, chord, sum(CASE WHEN contains(steps, step) THEN weight ELSE 0 END) AS score FROM w, chords GROUP BY ALL)
SELECT measure_key, chord, score FROM t QUALIFY row_number() OVER (PARTITION BY measure_key ORDER BY score DESC, ord) = 1""")
def a9(spark, sf_dir):
    return suggestions(spark, sf_dir)


# Candidate chords in order, with the letters of their tones.
CANDIDATES = [("C", "CEG"), ("Dm", "DFA"), ("Em", "EGB"), ("F", "FAC"), ("G", "GBD"), ("G7", "GBDF"), ("Am", "ACE"), ("Bdim", "BDF"), ("D", "DFA"), ("D7", "DFAC"), ("Bm", "BDF"), ("B7", "BDFA"), ("G/B", "BGD"), ("D/F#", "FDA")]


def suggestions(spark, sf_dir):
    """The chord whose tones weigh most in a measure; earlier candidates win ties."""
    weight = F.when(F.col("note_index") == 1, 3.0).otherwise(1.5) * F.when(F.col("duration") >= 3, 2.0).when(F.col("duration") == 2, 1.0).otherwise(0.5)
    by_step = core.notes(spark, sf_dir).where("not is_rest").groupBy("measure_key").agg(*[F.sum(F.when(F.col("step") == s, weight).otherwise(0.0)).alias(s) for s in core.STEPS])
    scored = [F.struct(sum((F.col(s) for s in steps[1:]), F.col(steps[0])).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("chord")) for i, (name, steps) in enumerate(CANDIDATES)]
    return by_step.select("measure_key", F.array_max(F.array(*scored)).alias("best")).select("measure_key", "best.chord", "best.score")


@query("j19_autofill_chords", """, have AS (SELECT DISTINCT measure_key FROM score_events WHERE kind = 'harmony') SELECT m.measure_key FROM measures m WHERE EXISTS (SELECT 1 FROM notes n WHERE n.measure_key = m.measure_key AND NOT is_rest) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.measure_key = m.measure_key)""")
def j19(spark, sf_dir):
    have = core.score_events(spark, sf_dir).where("kind = 'harmony'").select("measure_key").distinct()
    return suggestions(spark, sf_dir).join(have, "measure_key", "left_anti").select("measure_key")


@query("t7_nearest_reference", """, r AS (SELECT score_id, measure_idx, width FROM measures WHERE width IS NOT NULL), o AS (SELECT t.score_id, t.pos, r.measure_idx, row_number() OVER (PARTITION BY t.score_id, t.pos ORDER BY abs(t.x - r.width), r.measure_idx) AS k, abs(t.x - r.width) AS distance FROM tokens t JOIN r USING (score_id))
SELECT score_id, pos, CAST(distance AS DOUBLE) AS distance, measure_idx FROM o WHERE k = 1 AND distance <= 60""")
def t7(spark, sf_dir):
    r = core.measures(spark, sf_dir).where("width is not null").select("score_id", "measure_idx", F.col("width").cast("double").alias("rx"))
    t = core.tokens(spark, sf_dir).select("score_id", "pos", F.col("x").cast("double").alias("tx"))
    return ops.nearest(t, r, ["score_id"], ["score_id", "pos"], "tx", "rx", ["measure_idx"], "measure_idx", within=60.0)
