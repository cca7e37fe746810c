"""Queries over lyric structure, page headers and artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music, text
from ..operators import measures as m
from ..operators import structure as ops
from ..registry import query
from . import core
from .measures import CARRIED

#: Words with section (every fifth line is chorus), staff, page and expected verses.
SECTIONED = ", sectioned AS (SELECT score_id, pos, text, page, line % 4 AS staff, verse, CASE WHEN line % 5 = 4 THEN 'chorus' ELSE 'verse' END AS section, CASE WHEN line % 5 = 4 THEN 1 ELSE 3 END AS verse_count FROM tokens)"


def sectioned(spark, sf_dir, together=False):
    chorus = F.col("line") % 5 == 4
    return core.tokens(spark, sf_dir, together).select("score_id", "pos", "text", "page", (F.col("line") % 4).alias("staff"), "verse", "confidence", F.when(chorus, "chorus").otherwise("verse").alias("section"), F.when(chorus, 1).otherwise(3).alias("verse_count"))


@query("a15_structure_tree", SECTIONED + """, l AS (SELECT score_id, section, verse_count, verse, page, staff, min(pos) AS first, string_agg(text, ' ' ORDER BY pos) AS t FROM sectioned GROUP BY ALL), v AS (SELECT score_id, section, verse_count, verse, string_agg(page || '/' || staff || ':' || t, '|' ORDER BY first) AS t FROM l GROUP BY ALL)
SELECT score_id, section, array_to_string(list_filter(range(1, verse_count + 1), lambda k: NOT list_contains(list(verse), k)), ',') AS missing, md5(string_agg(verse || '=' || t, chr(10) ORDER BY verse)) AS tree_md5 FROM v GROUP BY score_id, section, verse_count""")
def a15(spark, sf_dir):
    t = ops.tree(sectioned(spark, sf_dir, True), ["score_id"])
    line = lambda l: F.concat(l["page"], F.lit("/"), l["staff"], F.lit(":"), F.array_join(l["syllables"], " "))
    shown = F.array_join(F.transform("verses", lambda v: F.concat(v["verse"], F.lit("="), F.array_join(F.transform(v["lines"], line), "|"))), "\n")
    return t.select("score_id", "section", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), F.md5(shown).alias("tree_md5"))


@query("a21_section_list", SECTIONED + " SELECT score_id, section, CASE WHEN section = 'chorus' THEN 1 ELSE max(verse) OVER (PARTITION BY score_id) END AS verse_count FROM (SELECT score_id, section, max(verse) AS v FROM sectioned GROUP BY ALL) JOIN (SELECT score_id, max(verse) AS verse FROM sectioned GROUP BY ALL) USING (score_id)")
def a21(spark, sf_dir):
    """Distinct sections; a chorus has one verse, others as many as the score."""
    s = sectioned(spark, sf_dir)
    top = s.groupBy("score_id").agg(F.max("verse").alias("top"))
    return s.select("score_id", "section").distinct().join(top, "score_id").select("score_id", "section", F.when(F.col("section") == "chorus", 1).otherwise(F.col("top")).alias("verse_count"))


@query("a23_merged_pages", SECTIONED + """, t AS (SELECT score_id, pos, 'p' || (page + 1) || '-' || section AS section_id, row_number() OVER (PARTITION BY score_id ORDER BY page, staff, verse, pos) AS place FROM sectioned)
SELECT score_id, section_id, count(*) AS words, min(place) AS first_place FROM t GROUP BY ALL""")
def a23(spark, sf_dir):
    """Pages of a score merged: sections keep their page in their id, words are sorted anew and counted."""
    place = F.row_number().over(Window.partitionBy("score_id").orderBy("page", "staff", "verse", "pos"))
    t = sectioned(spark, sf_dir).select("score_id", F.concat(F.lit("p"), F.col("page") + 1, F.lit("-"), "section").alias("section_id"), place.alias("place"))
    return t.groupBy("score_id", "section_id").agg(F.count("*").alias("words"), F.min("place").alias("first_place"))


@query("a17_page_progress", """, p AS (SELECT score_id, page, count(*) FILTER (confidence < 0.62) AS bad FROM tokens GROUP BY ALL)
SELECT score_id, count(*) AS total, count(*) FILTER (bad < 3) AS processed, 100 * count(*) FILTER (bad < 3) // count(*) AS percent, CASE WHEN count(*) FILTER (bad < 3) = count(*) THEN 'completed' WHEN count(*) FILTER (bad < 3 OR bad > 8) = count(*) THEN 'partial' ELSE 'processing' END AS status FROM p GROUP BY score_id""")
def a17(spark, sf_dir):
    from ..operators.review import progress

    p = core.tokens(spark, sf_dir).groupBy("score_id", "page").agg(F.count_if(F.col("confidence") < 0.62).alias("bad"))
    status = F.when(F.col("bad") < 3, "done").when(F.col("bad") > 8, "failed").otherwise("running")
    return progress(p.select("score_id", "page", F.lit(1).alias("at"), status.alias("status")))


#: Rows below the last staff of a page: one in six begins with a verse number.
ROWS = """, prows AS (SELECT score_id, page, line % 4 AS row, CASE WHEN (score_id + line) % 6 = 0 THEN 1 + line % 4 END AS verse, 100.0 * (line % 4) * (1 + line % 3) + 40 AS centre, 20.0 AS height, 0.0 AS bottom, 10.0 + score_id % 5 AS interline, min(pos) AS first FROM tokens GROUP BY ALL),
f AS (SELECT *, coalesce(verse >= 2, false) AS marker, centre - coalesce(lag(centre) OVER w, bottom) > 3 * height OR centre - bottom > 12 * interline AS far FROM prows WINDOW w AS (PARTITION BY score_id, page ORDER BY row)),
o AS (SELECT *, max(CASE WHEN marker AND far THEN 1 ELSE 0 END) OVER w AS open FROM f WINDOW w AS (PARTITION BY score_id, page ORDER BY row ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, nullif(sum(CASE WHEN marker AND open = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, page ORDER BY row ROWS UNBOUNDED PRECEDING), 0) AS stanza FROM o)"""


def stanza_rows(spark, sf_dir):
    line, score = F.col("line"), F.col("score_id")
    t = core.tokens(spark, sf_dir).groupBy("score_id", "page", "line").agg(F.min("pos").alias("first"))
    return t.select("score_id", "page", "line", (line % 4).alias("row"), F.when((score + line) % 6 == 0, 1 + line % 4).alias("verse"), (100.0 * (line % 4) * (1 + line % 3) + 40).alias("centre"), F.lit(20.0).alias("height"), F.lit(0.0).alias("bottom"), (10.0 + score % 5).alias("interline"))


@query("w13_poem_stanzas", ROWS + " SELECT score_id, page, row, CAST(stanza AS BIGINT) AS stanza FROM st")
def w13(spark, sf_dir):
    return ops.stanzas(stanza_rows(spark, sf_dir), ["score_id", "page"]).select("score_id", "page", "row", "stanza")


@query("j24_stanza_projection", ROWS + """, w AS (SELECT t.score_id, t.page, CAST(s.stanza AS BIGINT) AS stanza, t.pos, row_number() OVER (PARTITION BY t.score_id, t.page, s.stanza ORDER BY t.pos) AS place FROM tokens t JOIN st s ON s.score_id = t.score_id AND s.page = t.page AND s.row = t.line % 4 WHERE s.stanza IS NOT NULL),
tpl AS (SELECT score_id, page, pos AS anchor, confidence >= 0.62 AS accepted, row_number() OVER (PARTITION BY score_id, page ORDER BY pos) AS place FROM tokens WHERE line % 4 = 0),
g AS (SELECT w.score_id, w.page, w.stanza, count(*) AS n FROM w GROUP BY ALL), h AS (SELECT score_id, page, count(*) AS n, bool_and(accepted) AS ok FROM tpl GROUP BY ALL), fit AS (SELECT g.score_id, g.page, g.stanza, coalesce(g.n = h.n AND ok, false) AS fits FROM g LEFT JOIN h USING (score_id, page))
SELECT w.score_id, w.page, w.stanza, w.pos, CASE WHEN fits THEN anchor END AS anchor, CASE WHEN NOT fits THEN 'stanza_template_mismatch' END AS reason FROM w JOIN fit USING (score_id, page, stanza) LEFT JOIN tpl ON tpl.score_id = w.score_id AND tpl.page = w.page AND tpl.place = w.place""")
def j24(spark, sf_dir):
    keys = ["score_id", "page"]
    s = ops.stanzas(stanza_rows(spark, sf_dir), keys).select(*keys, "line", "stanza").where("stanza is not null")
    t = core.tokens(spark, sf_dir)
    nth = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("pos"))
    words = t.join(s, [*keys, "line"]).select(*keys, "stanza", "pos").withColumn("place", nth(*keys, "stanza"))
    template = t.where("line % 4 = 0").select(*keys, F.col("pos").alias("anchor"), (F.col("confidence") >= 0.62).alias("accepted"), nth(*keys).alias("place"))
    return ops.projected(template, words, keys).select(*keys, "stanza", "pos", "anchor", "reason")


CONTINUED = """, pg AS (SELECT score_id, page, arg_max(line % 5 = 4 OR length(text) % 3 = 0, pos) AS last_is_chorus, bool_or(length(text) > 13) AS explicit, CASE WHEN page % 2 = 1 THEN 1 ELSE count(DISTINCT verse) END AS verses FROM tokens GROUP BY score_id, page),
ab AS (SELECT *, NOT explicit AND verses = 1 AS able FROM pg), ch AS (SELECT *, sum(CASE WHEN able THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS chain FROM ab)"""


@query("w14_chorus_continuity", CONTINUED + " SELECT score_id, page, able AND coalesce(bool_or(last_is_chorus) OVER (PARTITION BY score_id, chain ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chorus FROM ch")
def w14(spark, sf_dir):
    t = core.tokens(spark, sf_dir).groupBy("score_id", "page").agg(F.max_by((F.col("line") % 5 == 4) | (F.length("text") % 3 == 0), "pos").alias("last_is_chorus"), F.bool_or(F.length("text") > 13).alias("explicit"), F.countDistinct("verse").alias("v"))
    pages = t.withColumn("verses", F.when(F.col("page") % 2 == 1, 1).otherwise(F.col("v"))).drop("v")
    return ops.continued(pages, ["score_id"]).select("score_id", "page", "chorus")


@query("w14_connected_sections")
def w14_connected(spark, sf_dir):
    """Words of a page (two systems of two lines) with the choruses that go on over page breaks, in counts by page and reason."""
    p, line = F.col("pos") % 32, F.col("line")
    t = core.tokens(spark, sf_dir).select("score_id", "page", F.col("pos").alias("seq"), F.floor(p / 16).alias("system"), F.col("x").cast("double").alias("x"), (20.0 * (line % 4)).alias("y"), F.lit(12.0).alias("h"), F.when((line % 5 == 4) | (F.length("text") % 3 == 0), "chorus").otherwise("verse").alias("section_type"), F.when(F.col("page") % 2 == 1, 1).otherwise(F.col("verse")).alias("verse"), (F.length("text") > 13).alias("explicit"))
    return ops.connected(t, ["score_id"]).groupBy("score_id", "page", "section", "reason").agg(F.count("*").alias("words"), F.count_if("review").alias("to_review"))


@query("w8_pickup_flag", CARRIED + ", d AS (SELECT e.measure_key, sum(duration) AS total FROM score_events e WHERE kind = 'note' GROUP BY ALL) SELECT c.measure_key, total > 0 AND total < coalesce(beats, 4) * 4 AS implicit FROM carried c JOIN d USING (measure_key) WHERE measure_idx = 1")
def w8(spark, sf_dir):
    """First measures shorter than their meter at four divisions (the editor's fixed assumption)."""
    d = core.score_events(spark, sf_dir).where("kind = 'note'").groupBy("measure_key").agg(F.sum("duration").alias("total"))
    c = m.carried(core.measures(spark, sf_dir)).where("measure_idx = 1").join(d, "measure_key")
    return c.select("measure_key", ((F.col("total") > 0) & (F.col("total") < F.coalesce("beats", F.lit(4)) * 4)).alias("implicit"))


CLEFS = """, clefs AS (SELECT score_id, measure_key, (measure_key % 50) / 100.0 AS grade, measure_key % 3 = 0 AS digit, CASE WHEN score_id % 5 = 0 THEN 1 ELSE -1 END + CASE WHEN score_id % 7 = 0 AND measure_key % 2 = 0 THEN 1 ELSE 0 END AS change FROM measures WHERE measure_key % 8 = 1),
pg AS (SELECT score_id, bool_and(grade < 0.35 AND NOT digit) AS unsupported, count(DISTINCT change) AS kinds, min(change) AS change FROM clefs GROUP BY ALL)"""


@query("w21_octave_correction", CLEFS + " SELECT n.measure_key, n.seq, n.octave + CASE WHEN unsupported AND kinds = 1 AND change IN (-1, 1) THEN -change ELSE 0 END AS octave FROM notes n LEFT JOIN pg USING (score_id)".replace("CASE WHEN unsupported AND", "CASE WHEN coalesce(unsupported, false) AND"))
def w21(spark, sf_dir):
    """Octave shifts go, and pitches move, only where no octave clef of a score has a good grade or a digit and all agree."""
    k, s = F.col("measure_key"), F.col("score_id")
    c = core.measures(spark, sf_dir).where("measure_key % 8 = 1").select("score_id", ((k % 50) / 100.0).alias("grade"), (k % 3 == 0).alias("digit"), (F.when(s % 5 == 0, 1).otherwise(-1) + F.when((s % 7 == 0) & (k % 2 == 0), 1).otherwise(0)).alias("change"))
    pg = c.groupBy("score_id").agg(F.bool_and((F.col("grade") < 0.35) & ~F.col("digit")).alias("unsupported"), F.countDistinct("change").alias("kinds"), F.min("change").alias("change"))
    shift = F.when(F.coalesce("unsupported", F.lit(False)) & (F.col("kinds") == 1) & F.col("change").isin(-1, 1), -F.col("change")).otherwise(0)
    return core.notes(spark, sf_dir).join(pg, "score_id", "left").select("measure_key", "seq", (F.col("octave") + shift).alias("octave"))


@query("u2_page_union", ", p AS (SELECT score_id, page + 1 AS page, count(*) AS words FROM tokens WHERE page = 0 GROUP BY ALL UNION ALL SELECT score_id, page + 1, count(*) FROM tokens WHERE page > 0 GROUP BY ALL) SELECT p.*, s.score_id IS NULL AS undefined_part FROM p LEFT JOIN scores s USING (score_id)")
def u2(spark, sf_dir):
    """Pages put together; parts that no score defines are marked as errors."""
    t = core.tokens(spark, sf_dir).groupBy("score_id", "page").agg(F.count("*").alias("words"))
    pages = t.where("page = 0").unionByName(t.where("page > 0"), allowMissingColumns=True).withColumn("page", F.col("page") + 1)
    known = core.scores(spark, sf_dir).select("score_id", F.lit(False).alias("undefined_part"))
    return pages.join(known, "score_id", "left").withColumn("undefined_part", F.coalesce("undefined_part", F.lit(True)))


#: Lines above the first staff: heading texts of a page with made boxes.
LETTERS_OF = "length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
UPPER = "CASE WHEN " + LETTERS_OF.format(t="t") + " > 0 THEN length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) / " + LETTERS_OF.format(t="t") + " ELSE 0.0 END"
HEADER = f""", hl AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|h2|title|p)>([^<]+)', 1)) AS t, generate_subscripts(regexp_extract_all(html, '<(?:h1|h2|title|p)>([^<]+)', 1), 1) - 1 AS nth FROM pages),
hb AS (SELECT *, 100.0 + 37 * (nth % 5) AS x1, 30.0 * nth AS y1, 100.0 + 37 * (nth % 5) + 6.0 * length(t) AS x2, 30.0 * nth + 12 + (length(t) % 5) * 2 AS y2, 0.5 + (length(t) % 50) / 100.0 AS score FROM hl),
hs AS (SELECT *, y2 - y1 AS h, (y1 + y2) / 2 AS cy, {UPPER} AS upper, max(y2 - y1) OVER (PARTITION BY page_id) AS mh FROM hb),
hr AS (SELECT *, 0.42 * least(h / mh, 1.0) + 0.33 * upper + 0.15 * least((x2 - x1) / greatest(1000.0 * 0.55, 1.0), 1.0) + 0.10 * (1 - least(abs((x1 + x2) / 2 - 500.0) / 500.0, 1.0)) AS rank FROM hs),
best AS (SELECT page_id, nth AS b_nth, h AS b_h, cy AS b_cy, upper AS b_upper FROM hr QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, nth) = 1),
titled AS (SELECT hr.*, nth = b_nth OR (h / greatest(b_h, 1.0) BETWEEN 0.8 AND 1.25 AND abs(upper - b_upper) < 0.2 AND abs(cy - b_cy) <= 1.5 * greatest(h, b_h)) AS is_title FROM hr JOIN best USING (page_id))"""


def header(spark, sf_dir):
    h = core.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|h2|title|p)>([^<]+)"), F.lit(1))).alias("nth", "text"))
    n, size = F.col("nth"), F.length("text")
    x1, y1 = 100.0 + 37 * (n % 5), 30.0 * n
    return h.select("page_id", "nth", "text", x1.alias("x1"), y1.alias("y1"), (x1 + 6.0 * size).alias("x2"), (y1 + 12 + (size % 5) * 2).alias("y2"), (0.5 + (size % 50) / 100.0).alias("score"))


@query("t3_title_lines", HEADER + " SELECT page_id, nth, round(rank, 9) AS rank, is_title FROM titled")
def t3_lines(spark, sf_dir):
    return ops.titles(header(spark, sf_dir), ["page_id"], 1000.0).select("page_id", "nth", F.round("rank", 9).alias("rank"), "is_title")


@query("a19_titles", HEADER + " SELECT page_id, string_agg(t, ' ' ORDER BY y1, x1, t) AS title, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(score) AS confidence FROM titled WHERE is_title GROUP BY page_id")
def a19(spark, sf_dir):
    return ops.assembled(ops.titles(header(spark, sf_dir), ["page_id"], 1000.0), ["page_id"])


@query("a20_header_model", HEADER + """, ti AS (SELECT page_id, string_agg(t, ' ' ORDER BY y1, x1, t) AS title, arg_min(cy, nth) AS ty FROM titled WHERE is_title GROUP BY page_id),
c AS (SELECT page_id, arg_max(t, nth) AS composer FROM titled JOIN ti USING (page_id) WHERE NOT is_title AND cy > ty AND (x1 + x2) / 2 > 620 GROUP BY page_id), n AS (SELECT page_id, arg_min(regexp_extract(t, '(\\d{1,4})', 1), nth) AS hymn_number FROM titled WHERE regexp_matches(t, '^#?\\d{1,4}') GROUP BY page_id),
d AS (SELECT page_id, string_agg(t, ' ' ORDER BY nth) AS description FROM titled JOIN ti USING (page_id) WHERE NOT is_title AND cy < ty GROUP BY page_id)
SELECT page_id, title, composer, hymn_number, description FROM ti LEFT JOIN c USING (page_id) LEFT JOIN n USING (page_id) LEFT JOIN d USING (page_id)""")
def a20(spark, sf_dir):
    """One row a page: title, what is right of it below as composer, the leading number, what is above as description."""
    l = ops.titles(header(spark, sf_dir), ["page_id"], 1000.0).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    w = Window.partitionBy("page_id")
    first = F.min_by(F.when(F.col("is_title"), F.col("cy")), F.when(F.col("is_title"), F.col("nth"))).over(w)
    role = F.when(F.col("is_title"), "title").when((F.col("cy") > F.col("ty")) & ((F.col("x1") + F.col("x2")) / 2 > 620), "composer").when(F.col("cy") < F.col("ty"), "description")
    l = l.withColumn("ty", first).withColumn("role", role)
    joined = lambda name, *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == name, F.struct(*order, "text")))), lambda x: x["text"]), " ")
    number = F.when(F.col("text").rlike(r"^#?\d{1,4}"), F.struct("nth", F.regexp_extract("text", r"(\d{1,4})", 1).alias("n")))
    return l.groupBy("page_id").agg(joined("title", "y1", "x1").alias("title"), F.max(F.when(F.col("role") == "composer", F.struct("nth", "text")))["text"].alias("composer"), F.min(number)["n"].alias("hymn_number"), F.nullif(joined("description", "nth"), F.lit("")).alias("description"))


@query("t8_fallback_header", HEADER + """, k AS (SELECT *, (x1 + x2) / 2 AS cx, max(h) OVER (PARTITION BY page_id) AS top_h FROM hs), m AS (SELECT *, h >= 0.65 * top_h AND cx BETWEEN 150 AND 850 AS is_t FROM k)
SELECT page_id, string_agg(t, ' ' ORDER BY CAST(round(cy / 40) AS BIGINT), cx, nth) FILTER (is_t) AS title, arg_min(t, nth) FILTER (NOT is_t AND cx > 650) AS composer, arg_min(t, nth) FILTER (NOT is_t AND cx < 450) AS lyricist FROM m GROUP BY page_id""")
def t8(spark, sf_dir):
    """High and centred lines as title, the first line right and left of it as composer and lyricist."""
    cx, cy, h = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("y2") - F.col("y1")
    l = header(spark, sf_dir).withColumns({"cx": cx, "row": F.round(cy / 40).cast("long"), "h": h}).withColumn("top", F.max("h").over(Window.partitionBy("page_id")))
    l = l.withColumn("is_t", (F.col("h") >= 0.65 * F.col("top")) & F.col("cx").between(150, 850))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_t"), F.struct("row", "cx", "nth", "text")))), lambda x: x["text"]), " ")
    side = lambda rule: F.min(F.when(~F.col("is_t") & rule, F.struct("nth", "text")))["text"]
    return l.groupBy("page_id").agg(F.nullif(title, F.lit("")).alias("title"), side(F.col("cx") > 650).alias("composer"), side(F.col("cx") < 450).alias("lyricist"))


@query("k1_ledger_artifact", CARRIED + " SELECT score_id, count(*) AS measures, sha256(string_agg('{\"measure\":' || measure_key || ',\"fifths\":' || fifths || '}', chr(10) ORDER BY measure_idx)) AS sha256 FROM carried GROUP BY score_id")
def k1(spark, sf_dir):
    """The lines that an artifact of each score holds, and their hash (see sources.artifacts for writing them whole or not at all)."""
    c = m.carried(core.measures(spark, sf_dir)).select("score_id", "measure_idx", F.to_json(F.struct(F.col("measure_key").alias("measure"), "fifths")).alias("j"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", "j"))), lambda x: x["j"]), "\n")
    return c.groupBy("score_id").agg(F.count("*").alias("measures"), F.sha2(body, 256).alias("sha256"))
