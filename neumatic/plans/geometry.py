"""Queries over page geometry: staff lines, bands, heads, marks, boxes against measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, music
from ..operators import geometry as ops
from ..operators import joins, sequences
from ..registry import query
from . import core
from .more import STAVES, staves

#: Lines of a staff as they were found: four to six, not quite even.
LINES = """, found AS (SELECT measure_key, list_sort(list_transform(range(0, 4 + measure_key % 3), lambda i: 90.0 * measure_idx + (5.0 + measure_key % 4) * i + (measure_key * (i + 1)) % 3)) AS lines, (measure_key % 100) / 800.0 AS ink FROM measures)"""


def found_lines(spark, sf_dir):
    k = F.col("measure_key")
    lines = F.transform(F.sequence(F.lit(0).cast("long"), 3 + k % 3), lambda i: 90.0 * F.col("measure_idx") + (5.0 + k % 4) * i + (k * (i + 1)) % 3)
    return core.measures(spark, sf_dir).select("measure_key", F.array_sort(lines).alias("lines"), ((k % 100) / 800.0).alias("ink"))


def shown(lines):
    return F.array_join(F.transform(lines, lambda v: F.round(v, 2).cast("double").cast("string")), ",")


@query("p31_five_lines", LINES + """, n AS (SELECT measure_key, CASE WHEN len(lines) = 4 THEN CASE WHEN lines[2] - lines[1] > 1.5 * (lines[4] - lines[1]) / 3 THEN list_prepend(lines[1] - (lines[4] - lines[1]) / 3, lines) ELSE list_append(lines, lines[4] + (lines[4] - lines[1]) / 3) END
  WHEN len(lines) > 5 THEN list_transform(range(0, 5), lambda i: lines[1] + i * (lines[-1] - lines[1]) / 4) ELSE lines END AS l FROM found)
SELECT measure_key, len(l) AS n, round(l[1], 3) AS top, round(l[3], 3) AS middle, round(l[5], 3) AS bottom FROM n""")
def p31(spark, sf_dir):
    l = found_lines(spark, sf_dir).select("measure_key", ops.five_lines(F.col("lines")).alias("l"))
    return l.select("measure_key", F.size("l").alias("n"), *[F.round(F.get("l", F.lit(i)), 3).alias(n) for i, n in ((0, "top"), (2, "middle"), (4, "bottom"))])


@query("p32_page_lines", LINES + " SELECT measure_key, lines[1] + 1000 AS top, lines[5] + 1000 AS bottom FROM found WHERE len(lines) = 5")
def p32(spark, sf_dir):
    l = found_lines(spark, sf_dir).select("measure_key", ops.page_lines(F.col("lines"), F.lit(1000.0)).alias("l")).where("l is not null")
    return l.select("measure_key", F.get("l", F.lit(0)).alias("top"), F.get("l", F.lit(4)).alias("bottom"))


@query("p24_staff_confidence", LINES + """, g AS (SELECT measure_key, ink, list_transform(range(1, len(lines)), lambda i: lines[i + 1] - lines[i]) AS g FROM found)
SELECT measure_key, round(least(1.0, 0.75 * greatest(0.0, 1 - list_aggregate(g, 'stddev_pop') / greatest(list_aggregate(g, 'median'), 1.0)) + 0.25 * least(8 * ink, 1.0)), 3) AS confidence FROM g""")
def p24(spark, sf_dir):
    return found_lines(spark, sf_dir).select("measure_key", ops.staff_confidence(F.col("lines"), F.col("ink")).alias("confidence"))


HEADS = ", heads AS (SELECT n.measure_key, n.seq, n.x, top - 10 + (n.seq * 7) % 50 AS y, 4.0 + n.duration AS width, s.top, s.bottom, s.interline FROM notes n JOIN staves s USING (measure_key) WHERE NOT is_rest)"


def heads(spark, sf_dir):
    n = core.notes(spark, sf_dir).where("not is_rest").select("score_id", "measure_key", "seq", "x", (4.0 + F.col("duration")).alias("width"))
    return n.join(staves(spark, sf_dir).drop("score_id"), "measure_key").withColumn("y", F.col("top") - 10 + (F.col("seq") * 7) % 50)


@query("p25_head_confidence", STAVES + HEADS + " SELECT measure_key, seq, CAST(round(CAST(greatest(0, least(1, (1 - 2 * abs(width / interline - 0.85) + CASE WHEN y BETWEEN top AND bottom THEN 0.9 ELSE 0.6 END) / 2)) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS confidence, round(CAST(greatest(0, least(1, (1 - 2 * abs(width / interline - 0.85) + CASE WHEN y BETWEEN top AND bottom THEN 0.9 ELSE 0.6 END) / 2)) AS DECIMAL(18, 9)), 2) < 0.6 AS suspicious FROM heads")
def p25(spark, sf_dir):
    c = heads(spark, sf_dir).select("measure_key", "seq", ops.head_confidence(F.col("y"), F.col("top"), F.col("bottom"), F.col("width"), F.col("interline")).alias("confidence"))
    return c.withColumn("suspicious", F.col("confidence") < 0.6)


@query("p17_staff_positions", STAVES + HEADS + " SELECT measure_key, seq, CAST(greatest(-8, least(16, ceil((y - top) / (interline / 2) - 0.5))) AS INT) AS position FROM heads")
def p17(spark, sf_dir):
    return heads(spark, sf_dir).select("measure_key", "seq", music.staff_position(F.col("y"), F.col("top"), F.col("interline")).alias("position"))


@query("p30_row_offset", STAVES + HEADS + " SELECT measure_key, seq, round((y - bottom) / interline, 6) AS row_offset FROM heads")
def p30(spark, sf_dir):
    return heads(spark, sf_dir).select("measure_key", "seq", F.round(ops.row_offset(F.col("y"), F.col("bottom"), F.col("interline")), 6).alias("row_offset"))


@query("p23_page_profile", ", q AS (SELECT page_id, (length(html) % 101) / 100.0 AS nb, (length(html) * 7) % 150 AS il, (length(html) * 3) % 70 AS bl FROM pages) SELECT page_id, CASE WHEN nb > 0.96 THEN 'already_binary' WHEN il > 90 THEN 'uneven_lighting' WHEN bl < 35 THEN 'low_resolution_or_blurred' ELSE 'clean_scan' END AS profile FROM q")
def p23(spark, sf_dir):
    n = F.length("html")
    return core.table(spark, sf_dir, "pages").select("page_id", ops.page_profile((n % 101) / 100.0, (n * 7) % 150, (n * 3) % 70).alias("profile"))


@query("a18_medians", STAVES + " SELECT score_id, median(interline) AS interline, median(bottom - top) AS height, median((top + bottom) / 2) AS centre FROM staves GROUP BY score_id")
def a18(spark, sf_dir):
    return staves(spark, sf_dir).groupBy("score_id").agg(F.median("interline").alias("interline"), F.median(F.col("bottom") - F.col("top")).alias("height"), F.median((F.col("top") + F.col("bottom")) / 2).alias("centre"))


SYSTEMS = STAVES + """, g AS (SELECT *, lag(bottom) OVER w AS prior_bottom, greatest(interline, lag(interline) OVER w) AS wide FROM staves WINDOW w AS (PARTITION BY score_id ORDER BY top, measure_key)),
systems AS (SELECT *, 1 + sum(CASE WHEN top - prior_bottom > 7 * wide AND NOT linked THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY top, measure_key ROWS UNBOUNDED PRECEDING) AS system FROM g),
ends AS (SELECT *, lead(top) OVER (PARTITION BY score_id ORDER BY top, measure_key) AS next_top, row_number() OVER (PARTITION BY score_id, system ORDER BY top, measure_key) = 1 AS is_first, lead(top) OVER (PARTITION BY score_id, system ORDER BY top, measure_key) IS NULL AS is_last, median(interline) OVER (PARTITION BY score_id) / 2 AS half FROM systems),
bands AS (SELECT score_id, measure_key, CAST(system AS BIGINT) AS system, 'above' AS kind, CASE WHEN prior_bottom IS NULL THEN 0.0 ELSE floor((prior_bottom + half + (top - half)) / 2) END AS y1, greatest(CASE WHEN prior_bottom IS NULL THEN 0.0 ELSE floor((prior_bottom + half + (top - half)) / 2) END, floor(top - half)) AS y2 FROM ends WHERE is_first
  UNION ALL SELECT score_id, measure_key, CAST(system AS BIGINT), 'between', floor(bottom + half), floor(next_top - half) FROM ends WHERE NOT is_last
  UNION ALL SELECT score_id, measure_key, CAST(system AS BIGINT), 'below', floor(bottom + half), CASE WHEN next_top IS NULL THEN 100000.0 ELSE floor((bottom + half + (next_top - half)) / 2) END FROM ends WHERE is_last)"""


@query("w10_bands", SYSTEMS + " SELECT measure_key, system, kind, CAST(y1 AS DOUBLE) AS y1, CAST(y2 AS DOUBLE) AS y2 FROM bands")
def w10(spark, sf_dir):
    s = ops.systems(staves(spark, sf_dir), ["score_id"])
    return ops.bands(s, ["score_id"], F.lit(100000)).select("measure_key", "system", "kind", "y1", "y2")


@query("w10_regions", SYSTEMS + """, t AS (SELECT score_id, system, min(top - 2 * interline) AS y1, max(bottom + 2 * interline) AS y2, max_by(interline, bottom) AS il FROM systems GROUP BY ALL), n AS (SELECT *, lead(y1) OVER (PARTITION BY score_id ORDER BY system) AS next_y FROM t)
SELECT score_id, CAST(system AS BIGINT) AS system, y1, y2, next_y - y2 >= 2 * il AS has_lyrics FROM n""")
def w10_regions(spark, sf_dir):
    """Music region of each system, and whether there is room for lyrics below it before the next."""
    s = ops.systems(staves(spark, sf_dir), ["score_id"])
    t = s.groupBy("score_id", "system").agg(F.min(F.col("top") - 2 * F.col("interline")).alias("y1"), F.max(F.col("bottom") + 2 * F.col("interline")).alias("y2"), F.max_by("interline", "bottom").alias("il"))
    room = F.lead("y1").over(Window.partitionBy("score_id").orderBy("system")) - F.col("y2")
    return t.select("score_id", "system", "y1", "y2", (room >= 2 * F.col("il")).alias("has_lyrics"))


SPANS = STAVES + """, a AS (SELECT n.score_id, n.measure_key, min(n.x) AS low, max(n.x) AS high, min(n.seq) AS first_seq, median((n.seq * 7) % 50) AS y, count(*) AS n FROM notes n WHERE NOT is_rest GROUP BY ALL),
spans AS (SELECT m.measure_key, CASE WHEN m.measure_key % 4 <> 0 THEN 20.0 * a.first_seq ELSE a.low - s.interline END AS x1, CASE WHEN m.measure_key % 4 <> 0 THEN 20.0 * a.first_seq + 140 ELSE a.high + s.interline END AS x2, m.measure_key % 4 <> 0 AND a.n IS NOT NULL AS verified, a.y, s.interline, s.top, m.measure_key % 7 = 0 AS no_lines FROM measures m JOIN staves s USING (measure_key) LEFT JOIN a USING (measure_key))"""


def spans(spark, sf_dir):
    """Measures with the box of their first anchor (three of four have one) or, unverified, the reach of their anchors."""
    n = core.notes(spark, sf_dir).where("not is_rest")
    a = n.groupBy("measure_key").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.min("seq").alias("first_seq"), F.median((F.col("seq") * 7) % 50).alias("y"), F.count("*").alias("n"))
    j = staves(spark, sf_dir).join(a, "measure_key", "left")
    has = F.col("measure_key") % 4 != 0
    return j.select("measure_key", F.when(has, 20.0 * F.col("first_seq")).otherwise(F.col("low") - F.col("interline")).alias("x1"), F.when(has, 20.0 * F.col("first_seq") + 140).otherwise(F.col("high") + F.col("interline")).alias("x2"), (has & F.col("n").isNotNull()).alias("verified"), "y", "interline", "top", (F.col("measure_key") % 7 == 0).alias("no_lines"))


@query("j3_measure_spans", SPANS + " SELECT measure_key, coalesce(x1, 0) AS x1, coalesce(x2, 100) AS x2, verified FROM spans")
def j3(spark, sf_dir):
    return spans(spark, sf_dir).select("measure_key", F.coalesce("x1", F.lit(0.0)).alias("x1"), F.coalesce("x2", F.lit(100.0)).alias("x2"), "verified")


@query("j4_staff_geometry", SPANS + " SELECT measure_key, CASE WHEN no_lines THEN coalesce(y, 100) - 2 * interline ELSE top END AS first_line, CASE WHEN no_lines THEN coalesce(y, 100) + 2 * interline ELSE top + 4 * interline END AS last_line FROM spans")
def j4(spark, sf_dir):
    """Five lines around the middle of the notes where no staff was found."""
    made = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.coalesce("y", F.lit(100.0)) + i * F.col("interline"))
    real = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("top") + i * F.col("interline"))
    l = spans(spark, sf_dir).withColumn("lines", F.when(F.col("no_lines"), made).otherwise(real))
    return l.select("measure_key", F.get("lines", F.lit(0)).alias("first_line"), F.get("lines", F.lit(4)).alias("last_line"))


POINTS = STAVES + ", points AS (SELECT score_id, pos, x, CAST(18 * line + length(text) AS DOUBLE) AS y FROM tokens)"


def points(spark, sf_dir):
    return core.tokens(spark, sf_dir).select("score_id", "pos", "x", (18.0 * F.col("line") + F.length("text")).alias("y"))


@query("j10_notes_in_staff", POINTS + """, j AS (SELECT p.score_id, p.pos, s.measure_idx, abs(y - (top + bottom) / 2) AS off FROM points p JOIN staves s ON p.score_id = s.score_id AND y >= top - (bottom - top) / 2 AND y < bottom + (bottom - top) / 2)
SELECT score_id, pos, arg_min(measure_idx, {'o': off, 'm': measure_idx}) AS staff FROM j GROUP BY ALL""")
def j10(spark, sf_dir):
    half = (F.col("bottom") - F.col("top")) / 2
    s = staves(spark, sf_dir).select("score_id", "measure_idx", (F.col("top") - half).alias("low"), (F.col("bottom") + half).alias("high"), ((F.col("top") + F.col("bottom")) / 2).alias("mid"))
    met = joins.contained(points(spark, sf_dir), s, ["score_id"], "y", "low", "high", 50.0)
    return met.groupBy("score_id", "pos").agg(F.min_by("measure_idx", F.struct(F.abs(F.col("y") - F.col("mid")), "measure_idx")).alias("staff"))


@query("j11_nearest_staff", POINTS + " SELECT score_id, pos, arg_min(measure_idx, {'o': abs(y - (top + bottom) / 2), 'm': measure_idx}) AS staff, min(abs(y - (top + bottom) / 2)) AS distance FROM points JOIN staves USING (score_id) GROUP BY ALL")
def j11(spark, sf_dir):
    s = staves(spark, sf_dir).select("score_id", F.col("measure_idx").alias("staff"), ((F.col("top") + F.col("bottom")) / 2).alias("mid"))
    return joins.nearest(points(spark, sf_dir), s, ["score_id"], ["score_id", "pos"], "y", "mid", ["staff"], "staff")


INK = STAVES + """, blobs AS (SELECT score_id, pos, x AS x1, 18.0 * line AS y1, x + 3 * length(text) AS x2, 18.0 * line + 2 + length(text) AS y2 FROM tokens), known AS (SELECT s.score_id, e.measure_key, e.seq, e.x AS x1, s.top - 30 AS y1, e.x + 12 AS x2, s.top - 18 AS y2, s.interline FROM score_events e JOIN staves s USING (measure_key) WHERE e.kind = 'harmony')"""


@query("j14_unexplained_ink", INK + """ SELECT score_id, pos FROM blobs b WHERE (x2 - x1) * (y2 - y1) >= 0.15 * 36 AND y2 - y1 BETWEEN 3 AND 24
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.score_id = b.score_id AND b.x1 < k.x2 + 0.4 * interline AND b.x2 > k.x1 - 0.4 * interline AND b.y1 < k.y2 + 0.3 * interline AND b.y2 > k.y1 - 0.3 * interline)""")
def j14(spark, sf_dir):
    """Blobs of a fitting size that no read chord explains, with margins of 0.4 and 0.3 staff spaces."""
    n = F.length("text")
    b = core.tokens(spark, sf_dir).select("score_id", "pos", F.col("x").cast("double").alias("bx1"), (18.0 * F.col("line")).alias("by1"), (F.col("x") + 3.0 * n).alias("bx2"), (18.0 * F.col("line") + 2 + n).alias("by2"))
    b = b.where(((F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1")) >= 0.15 * 36) & (F.col("by2") - F.col("by1")).between(3, 24))
    e = core.score_events(spark, sf_dir).where("kind = 'harmony'").select("measure_key", "x")
    k = e.join(staves(spark, sf_dir), "measure_key").select("score_id", F.col("x").alias("kx1"), (F.col("top") - 30).alias("ky1"), (F.col("x") + 12).alias("kx2"), (F.col("top") - 18).alias("ky2"), "interline")
    # chords are met by cell of 40 units: each is listed in every cell that it and its margin reach
    k = k.withColumn("cell", F.explode(F.sequence(F.floor((F.col("ky1") - 0.3 * F.col("interline")) / 40), F.floor((F.col("ky2") + 0.3 * F.col("interline")) / 40))))
    placed = b.withColumn("cell", F.explode(F.sequence(F.floor(F.col("by1") / 40), F.floor(F.col("by2") / 40))))
    meets = boxes.overlaps(tuple(F.col(c) for c in ("bx1", "by1", "bx2", "by2")), tuple(F.col(c) for c in ("kx1", "ky1", "kx2", "ky2")), 0.4 * F.col("interline"), 0.3 * F.col("interline"))
    explained = placed.join(k, ["score_id", "cell"]).where(meets).select("score_id", "pos").distinct()
    return b.join(explained, ["score_id", "pos"], "left_anti").select("score_id", "pos")


MARKS = STAVES + """, digits AS (SELECT e.score_id, e.measure_key, e.seq, e.x AS cx, s.top - 12 + e.seq % 9 AS cy, 1 + e.duration * 2 AS number, s.top, s.bottom, s.interline FROM score_events e JOIN staves s USING (measure_key) WHERE e.kind <> 'backup'),
ok AS (SELECT * FROM digits WHERE number IN (3, 5, 7) AND cy BETWEEN top - 3 * interline AND bottom + 3 * interline AND cy < top - 0.3 * interline)"""


@query("j15_tuplet_marks", MARKS + " SELECT measure_key, seq, number FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.measure_key = a.measure_key AND b.seq < a.seq AND abs(a.cx - b.cx) < 0.6 * a.interline * 5 AND abs(a.cy - b.cy) < a.interline)")
def j15(spark, sf_dir):
    """Digits 3, 5, 7 above a staff, without those close to an earlier one of their measure."""
    e = core.score_events(spark, sf_dir).where("kind <> 'backup'").select("measure_key", "seq", F.col("x").alias("cx"), (1 + F.col("duration") * 2).alias("number"))
    d = e.join(staves(spark, sf_dir), "measure_key").withColumn("cy", F.col("top") - 12 + F.col("seq") % 9)
    ok = d.where(F.col("number").isin(3, 5, 7) & F.col("cy").between(F.col("top") - 3 * F.col("interline"), F.col("bottom") + 3 * F.col("interline")) & (F.col("cy") < F.col("top") - 0.3 * F.col("interline")))
    earlier = ok.select("measure_key", F.col("seq").alias("s"), F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    near = (earlier["measure_key"] == ok["measure_key"]) & (earlier["s"] < ok["seq"]) & (F.abs(ok["cx"] - earlier["x0"]) < 3.0 * ok["interline"]) & (F.abs(ok["cy"] - earlier["y0"]) < ok["interline"])
    return ok.join(earlier, near, "left_anti").select("measure_key", "seq", "number")


@query("j31_notes_in_box", STAVES + HEADS + " SELECT measure_key, string_agg(seq || ':' || CAST(floor(x) AS INT), ' ' ORDER BY x, seq) AS tokens FROM heads WHERE x >= 20 AND x < 160 AND y BETWEEN top - 2 * interline AND bottom + 2 * interline GROUP BY measure_key")
def j31(spark, sf_dir):
    inside = (F.col("x") >= 20) & (F.col("x") < 160) & F.col("y").between(F.col("top") - 2 * F.col("interline"), F.col("bottom") + 2 * F.col("interline"))
    token = F.concat("seq", F.lit(":"), F.col("x").cast("int"))
    return heads(spark, sf_dir).where(inside).groupBy("measure_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", token.alias("t")))), lambda v: v["t"]), " ").alias("tokens"))


@query("t5_heads_in_order", STAVES + HEADS + " SELECT measure_key, seq, row_number() OVER (PARTITION BY measure_key ORDER BY x, y, seq) AS place, first_value(seq) OVER (PARTITION BY measure_key ORDER BY x, y, seq) AS leftmost FROM heads")
def t5(spark, sf_dir):
    w = Window.partitionBy("measure_key").orderBy("x", "y", "seq")
    return heads(spark, sf_dir).select("measure_key", "seq", F.row_number().over(w).alias("place"), F.first("seq").over(w).alias("leftmost"))


@query("t4_lyrics_order", " SELECT score_id, pos, row_number() OVER (PARTITION BY score_id ORDER BY page, line % 4, verse, 18.0 * line, x, pos) AS place FROM tokens")
def t4(spark, sf_dir):
    w = Window.partitionBy("score_id").orderBy("page", F.col("line") % 4, "verse", 18.0 * F.col("line"), "x", "pos")
    return core.tokens(spark, sf_dir).select("score_id", "pos", F.row_number().over(w).alias("place"))


@query("p29_box_algebra", " SELECT score_id, pos, x + 1.5 * length(text) AS cx, greatest(0, least(x + 3 * length(text), x + 4 + 2 * length(text)) - greatest(x, x + 4)) * 10.0 / greatest(3 * length(text) * 12.0 + 2 * length(text) * 10.0 - greatest(0, least(x + 3 * length(text), x + 4 + 2 * length(text)) - greatest(x, x + 4)) * 10.0, 1) AS overlap FROM tokens")
def p29(spark, sf_dir):
    """Centre of each word's box, and its overlap with a narrower box read elsewhere."""
    n, x = F.length("text"), F.col("x")
    a = (x + 0.0, F.lit(0.0), x + 3.0 * n, F.lit(12.0))
    return core.tokens(spark, sf_dir).select("score_id", "pos", boxes.center(a)[0].alias("cx"), boxes.iou(a, (x + 4.0, F.lit(1.0), x + 4.0 + 2.0 * n, F.lit(11.0))).alias("overlap"))


@query("p33_spatial_gate", ", p AS (SELECT score_id, line, verse, x // 24 AS note, pos, abs(x % 24 - 12) / 8.0 AS error, pos % 13 <> 0 AS reliable FROM tokens) SELECT score_id, line, verse, note, max(pos) AS pos FROM p WHERE error <= 1 AND reliable GROUP BY ALL")
def p33(spark, sf_dir):
    """Proposals within a staff space of reliable geometry; the last word of a note and verse wins."""
    x = F.col("x")
    t = core.tokens(spark, sf_dir).where((F.abs(x % 24 - 12) / 8.0 <= 1) & (F.col("pos") % 13 != 0))
    return t.groupBy("score_id", "line", "verse", F.floor(x / 24).alias("note")).agg(F.max("pos").alias("pos"))


@query("p34_usable_words", " SELECT score_id, count(*) FILTER (trim(text) <> '' AND 100 * confidence - 50 >= 20) AS usable, count(*) FILTER (confidence < 0.65) AS suspicious FROM tokens GROUP BY score_id")
def p34(spark, sf_dir):
    return core.tokens(spark, sf_dir).groupBy("score_id").agg(F.count_if((F.trim("text") != "") & (100 * F.col("confidence") - 50 >= 20)).alias("usable"), F.count_if(F.col("confidence") < 0.65).alias("suspicious"))


@query("j16_latest_run", """, r AS (SELECT run_id, page, engine, text, md5(text) AS hash, length(text) AS finished FROM runs), l AS (SELECT run_id, hash, arg_max(page, {'f': finished, 'p': page}) AS page FROM r WHERE engine <> 'system' GROUP BY ALL),
n AS (SELECT run_id, page, unnest(range(0, length(text) // 40 + 1)) AS k FROM r), s AS (SELECT l.run_id, l.hash, count(DISTINCT k // 3) AS sources, min(k // 3) AS source FROM l JOIN n USING (run_id, page) WHERE k * 40 % 200 BETWEEN 20 AND 160 GROUP BY ALL)
SELECT run_id, hash, source FROM s WHERE sources = 1""")
def j16(spark, sf_dir):
    """Latest run of the same page hash, and the one measure that its note positions inside the box come from."""
    r = core.runs(spark, sf_dir).withColumns({"hash": F.md5("text"), "finished": F.length("text")})
    latest = r.where("engine <> 'system'").groupBy("run_id", "hash").agg(F.max_by("page", F.struct("finished", "page")).alias("page"))
    notes = r.select("run_id", "page", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int"))).alias("k"))
    inside = latest.join(notes, ["run_id", "page"]).where((F.col("k") * 40 % 200).between(20, 160))
    return inside.groupBy("run_id", "hash").agg(F.countDistinct(F.floor(F.col("k") / 3)).alias("sources"), F.min(F.floor(F.col("k") / 3)).alias("source")).where("sources = 1").drop("sources")


@query("j9_rows_to_staves")
def j9(spark, sf_dir):
    """Text rows of a score (a line each, the staff of measure k at 90 k) to the staff that they lie under."""
    size, line = F.max(F.length("text")), F.col("line")
    r = core.tokens(spark, sf_dir).groupBy("score_id", "line").agg(size.alias("h"), (F.max(F.length("text")) % 4 != 0).alias("sung"))
    y = 115.0 + 22 * line
    rows = r.select("score_id", line.alias("row_id"), F.lit(0.0).alias("x1"), y.alias("y1"), F.lit(100.0).alias("x2"), (y + F.col("h")).alias("y2"), "sung")
    s = staves(spark, sf_dir).select("score_id", F.col("measure_idx").alias("staff_id"), F.lit(0.0).alias("x1"), F.col("top").alias("y1"), F.lit(120.0).alias("x2"), F.col("bottom").alias("y2"))
    return sequences.assign_rows(rows, s, ["score_id"])
