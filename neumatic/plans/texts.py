"""Queries over lyric text: scalars, verses, export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music, text
from ..operators import tables
from ..registry import query
from ..sources import files
from . import core

VN = ", m AS (SELECT '" + text.MARKED + "' AS marked, '" + text.FOLDED + "' AS folded, '" + text.TONELESS + "' AS toneless)"


@query("x2_fold", VN + " SELECT score_id, pos, regexp_replace(translate(lower(text), marked, folded), '[^\\p{L}\\p{N}]', '', 'g') AS folded FROM tokens, m")
def x2(spark, sf_dir):
    return core.tokens(spark, sf_dir).select("score_id", "pos", text.fold(F.col("text")).alias("folded"))


@query("x3_strip_tone", VN + " SELECT score_id, pos, translate(lower(text), marked, toneless) AS toneless, len(list_filter(string_split(lower(text), ''), lambda c: c <> '' AND instr(marked, c) > 0 AND translate(c, marked, folded) <> c)) AS marks FROM tokens, m")
def x3(spark, sf_dir):
    return core.tokens(spark, sf_dir).select("score_id", "pos", text.strip_tone(F.col("text")).alias("toneless"), text.mark_count(F.col("text")).cast("long").alias("marks"))


@query("p20_syllabic", """, h AS (SELECT score_id, pos, CASE WHEN pos % 4 = 0 THEN '-' ELSE '' END || text || CASE WHEN pos % 6 = 0 THEN '-' ELSE '' END AS t FROM tokens WHERE text <> '')
SELECT score_id, pos, trim(regexp_replace(t, '^-+|-+$', '', 'g'), ' ') AS text, CASE WHEN starts_with(t, '-') AND ends_with(t, '-') THEN 'middle' WHEN ends_with(t, '-') THEN 'begin' WHEN starts_with(t, '-') THEN 'end' ELSE 'single' END AS syllabic FROM h""")
def p20(spark, sf_dir):
    t = core.tokens(spark, sf_dir).where("text <> ''")
    hyphened = F.concat(F.when(F.col("pos") % 4 == 0, "-").otherwise(""), "text", F.when(F.col("pos") % 6 == 0, "-").otherwise(""))
    return t.select("score_id", "pos", text.syllabic(hyphened).alias("s")).select("score_id", "pos", "s.text", "s.syllabic")


@query("x22_uppercase_ratio", " SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) ELSE 0.0 END AS ratio FROM documents")
def x22(spark, sf_dir):
    return core.table(spark, sf_dir, "documents").select("doc_id", text.uppercase_ratio(F.col("text")).alias("ratio"))


@query("x7_match_case", """, l AS (SELECT score_id, pos, text, regexp_replace(text, '[^\\p{L}]', '', 'g') AS letters, lead(text) OVER (PARTITION BY score_id ORDER BY pos) AS next FROM tokens)
SELECT score_id, pos, CASE WHEN length(letters) > 1 AND letters = replace(replace(upper(letters), 'ß', 'SS'), 'ẞ', 'SS') THEN replace(replace(upper(next), 'ß', 'SS'), 'ẞ', 'SS') WHEN left(letters, 1) <> '' AND left(letters, 1) = replace(replace(upper(left(letters, 1)), 'ß', 'SS'), 'ẞ', 'SS') THEN replace(replace(upper(left(next, 1)), 'ß', 'SS'), 'ẞ', 'SS') || substr(next, 2) ELSE next END AS cased FROM l WHERE next IS NOT NULL""")
def x7(spark, sf_dir):
    t = core.tokens(spark, sf_dir).withColumn("next", F.lead("text").over(Window.partitionBy("score_id").orderBy("pos"))).where("next is not null")
    return t.select("score_id", "pos", text.match_case(F.col("next"), F.col("text")).alias("cased"))


@query("p10_chord_grammar", """, c AS (SELECT score_id, pos, upper(left(text, 1)) || substr(text, 2) AS t FROM tokens)
SELECT score_id, pos, t FROM c WHERE regexp_full_match(trim(t), '[A-G][#b♯♭]?(?:min|maj|dim|aug|sus[24]?|m|M|°|\\+)?(?:6|7|9|11|13)?(?:add(?:2|4|6|9|11|13)|maj7|[#b](?:5|9|11|13))*(?:/[A-G][#b♯♭]?)?')""")
def p10(spark, sf_dir):
    c = core.tokens(spark, sf_dir).select("score_id", "pos", F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 1 << 30)).alias("t"))
    return c.where(music.is_chord(F.col("t")))


SYMBOL = ", sym AS (SELECT measure_key, seq, step || CASE alter_by WHEN 1 THEN '#' WHEN -1 THEN 'b' ELSE '' END || ['', 'm', '7', 'maj7', 'sus4', 'x'][duration + CASE WHEN voice = 2 THEN 2 ELSE 0 END] || CASE WHEN octave = 5 THEN '/G' ELSE '' END AS symbol FROM score_events WHERE kind = 'harmony')"


def symbols(spark, sf_dir):
    e = core.score_events(spark, sf_dir).where("kind = 'harmony'")
    quality = F.element_at(F.array(*[F.lit(x) for x in ["", "m", "7", "maj7", "sus4", "x"]]), (F.col("duration") + F.when(F.col("voice") == 2, 2).otherwise(0)).cast("int"))
    accidental = F.when(F.col("alter_by") == 1, "#").when(F.col("alter_by") == -1, "b").otherwise("")
    return e.select("measure_key", "seq", F.concat("step", accidental, quality, F.when(F.col("octave") == 5, "/G").otherwise("")).alias("symbol"))


@query("p11_chord_struct", SYMBOL + """ SELECT measure_key, seq, left(symbol, 1) AS step, CASE regexp_extract(symbol, '^[A-G]([#b]?)', 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS alter_by,
  CASE regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) WHEN '' THEN 'major' WHEN 'm' THEN 'minor' WHEN '7' THEN 'dominant' WHEN 'maj7' THEN 'major-seventh' WHEN 'sus4' THEN 'suspended-fourth' END AS kind, nullif(regexp_extract(symbol, '/([A-G])', 1), '') AS bass FROM sym""")
def p11(spark, sf_dir):
    return symbols(spark, sf_dir).select("measure_key", "seq", music.chord_parts(F.col("symbol")).alias("c")).select("measure_key", "seq", "c.step", F.col("c.alter").alias("alter_by"), "c.kind", F.col("c.bass_step").alias("bass"))


#: Symbols with additions and alterations behind their quality; every fourth has something that cannot be read.
RICH = SYMBOL + """, rich AS (SELECT measure_key, seq, regexp_replace(symbol, '^([A-G][#b]?[^/]*)', '\\1' || ['', 'add9', 'b5#9', 'b9y'][1 + seq % 4]) AS symbol FROM sym),
q AS (SELECT *, regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) AS quality FROM rich), b AS (SELECT *, CASE WHEN seq % 4 = 0 THEN quality ELSE regexp_replace(quality, '(add9|b5#9|b9y)$', '') END AS base FROM q)"""


@query("p11_chord_degrees", RICH + """ SELECT measure_key, seq, symbol, CASE WHEN seq % 4 < 3 THEN CASE base WHEN '' THEN 'major' WHEN 'm' THEN 'minor' WHEN '7' THEN 'dominant' WHEN 'maj7' THEN 'major-seventh' WHEN 'sus4' THEN 'suspended-fourth' END END AS kind,
  CASE WHEN seq % 4 < 3 AND base IN ('', 'm', '7', 'maj7', 'sus4') THEN ['', '9:0:add', '5:-1:alter,9:1:alter', ''][1 + seq % 4] END AS degrees FROM b""")
def p11_degrees(spark, sf_dir):
    """Kind and degrees of symbols; neither for those that need review."""
    more = F.element_at(F.array(*map(F.lit, ["", "add9", "b5#9", "b9y"])), (F.col("seq") % 4 + 1).cast("int"))
    parts = lambda i: F.regexp_extract("symbol", r"^([A-G][#b]?[^/]*)(.*)$", i)
    rich = symbols(spark, sf_dir).select("measure_key", "seq", F.concat(parts(1), more, parts(2)).alias("symbol")).withColumn("c", music.chord_struct(F.col("symbol")))
    return rich.select("measure_key", "seq", "symbol", F.col("c.kind").alias("kind"), F.array_join(F.transform("c.degrees", lambda d: F.concat_ws(":", d["value"], d["alter"], d["type"])), ",").alias("degrees"))


@query("p9_transpose_symbol", SYMBOL + """, p AS (SELECT *, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'] AS names, (instr('C.D.EF.G.A.B', left(symbol, 1)) - 1 + CASE regexp_extract(symbol, '^[A-G]([#b]?)', 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 3 + 12) % 12 AS root FROM sym)
SELECT measure_key, seq, names[root + 1] || regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) || CASE WHEN contains(symbol, '/') THEN '/' || names[(7 + 3) % 12 + 1] ELSE '' END AS symbol FROM p""")
def p9(spark, sf_dir):
    return symbols(spark, sf_dir).select("measure_key", "seq", music.transposed_symbol(F.col("symbol"), 3).alias("symbol"))


@query("k2_lyrics_text", " SELECT score_id, string_agg('VERSE ' || verse || chr(10) || words, chr(10) || chr(10) ORDER BY verse) AS lyrics FROM (SELECT score_id, verse, string_agg(text, ' ' ORDER BY pos) AS words FROM tokens WHERE trim(text, ' ') <> '' GROUP BY ALL) GROUP BY score_id")
def k2(spark, sf_dir):
    w = core.tokens(spark, sf_dir).where(F.trim("text") != "").groupBy("score_id", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("words"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("verse", "words"))), lambda x: F.concat(F.lit("VERSE "), x["verse"], F.lit("\n"), x["words"]))
    return w.groupBy("score_id").agg(F.array_join(v, "\n\n").alias("lyrics"))


@query("a14_verse_map", " SELECT score_id, verse, count(*) AS n, string_agg(text, '|' ORDER BY pos) AS words FROM tokens GROUP BY ALL")
def a14(spark, sf_dir):
    return core.tokens(spark, sf_dir).groupBy("score_id", "verse").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|").alias("words"))


@query("a5_confidence_summary", " SELECT score_id, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS lowest, count(*) FILTER (confidence < 0.8) AS low FROM tokens GROUP BY score_id")
def a5(spark, sf_dir):
    return core.tokens(spark, sf_dir).groupBy("score_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("lowest"), F.count_if(F.col("confidence") < 0.8).alias("low"))


@query("a12_songbook_counts", " SELECT book, count(*) AS n, min(title) AS first_title FROM scores GROUP BY book")
def a12(spark, sf_dir):
    return core.scores(spark, sf_dir).groupBy("book").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query("k5_songbook_contents", """, p AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY title, score_id) AS place FROM scores)
SELECT book, place, lpad(place::VARCHAR, greatest(4, length(place::VARCHAR))::INT, ' ') || '  ' || rpad(title, greatest(30, length(title))::INT, '.') || lpad(score_id::VARCHAR, greatest(8, length(score_id::VARCHAR))::INT, ' ') AS line FROM p
UNION ALL SELECT book, count(*) + 1, 'TOTAL ' || lpad(CAST(count(*) AS VARCHAR), 8, ' ') FROM p GROUP BY book""")
def k5(spark, sf_dir):
    """Numbered lines of each book and its total; a book is numbered in ranges of titles, each from where the one before ends."""
    return tables.contents(core.scores(spark, sf_dir))


@query("w12_section_islands", """, l AS (SELECT score_id, line, CASE WHEN max(length(text)) % 3 = 0 THEN 'chorus' ELSE 'verse' END AS label, count(*) AS n FROM tokens GROUP BY ALL),
f AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY score_id ORDER BY line) THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY score_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM f)
SELECT score_id, CAST(section AS BIGINT) AS section, label, min(line) AS first_line, max(line) AS last_line, CAST(sum(n) AS BIGINT) AS words FROM g GROUP BY score_id, section, label""")
def w12(spark, sf_dir):
    lines = core.tokens(spark, sf_dir).groupBy("score_id", "line").agg(F.when(F.max(F.length("text")) % 3 == 0, "chorus").otherwise("verse").alias("label"), F.count("*").alias("n"))
    w = Window.partitionBy("score_id").orderBy("line")
    new = (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("long")
    g = lines.withColumn("new", new).withColumn("section", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("score_id", "section", "label").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum("n").alias("words"))


@query("w15_normalised_positions", " SELECT score_id, pos, CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END AS place FROM tokens WINDOW w AS (PARTITION BY score_id, line)")
def w15(spark, sf_dir):
    w = Window.partitionBy("score_id", "line")
    low, high = F.min("x").over(w), F.max("x").over(w)
    return core.tokens(spark, sf_dir).select("score_id", "pos", F.when(high == low, 0.5).otherwise((F.col("x") - low) / (high - low)).alias("place"))


@query("w5_syllabic_chain", """, s AS (SELECT score_id, verse, pos, CASE WHEN pos % 4 = 0 AND pos % 6 = 0 THEN 'middle' WHEN pos % 6 = 0 THEN 'begin' WHEN pos % 4 = 0 THEN 'end' ELSE 'single' END AS syllabic FROM tokens),
l AS (SELECT *, lag(syllabic) OVER w AS prior, lead(syllabic) OVER w AS next FROM s WINDOW w AS (PARTITION BY score_id, verse ORDER BY pos))
SELECT score_id, pos, CASE WHEN syllabic IN ('middle', 'end') AND coalesce(prior, 'end') NOT IN ('begin', 'middle') THEN 'not_open' WHEN syllabic IN ('begin', 'single') AND prior IN ('begin', 'middle') THEN 'still_open' WHEN next IS NULL AND syllabic IN ('begin', 'middle') THEN 'never_closed' END AS issue FROM l
WHERE (syllabic IN ('middle', 'end') AND coalesce(prior, 'end') NOT IN ('begin', 'middle')) OR (syllabic IN ('begin', 'single') AND prior IN ('begin', 'middle')) OR (next IS NULL AND syllabic IN ('begin', 'middle'))""")
def w5(spark, sf_dir):
    p = F.col("pos")
    s = F.when((p % 4 == 0) & (p % 6 == 0), "middle").when(p % 6 == 0, "begin").when(p % 4 == 0, "end").otherwise("single")
    w = Window.partitionBy("score_id", "verse").orderBy("pos")
    t = core.tokens(spark, sf_dir).withColumn("s", s).withColumns({"prior": F.lag("s").over(w), "next": F.lead("s").over(w)})
    open_ = F.coalesce(F.col("prior").isin("begin", "middle"), F.lit(False))
    issue = F.when(F.col("s").isin("middle", "end") & ~open_, "not_open").when(F.col("s").isin("begin", "single") & open_, "still_open").when(F.col("next").isNull() & F.col("s").isin("begin", "middle"), "never_closed")
    return t.select("score_id", "pos", issue.alias("issue")).where("issue is not null")


#: DuckDB counts bytes; one byte stands for each letter beyond ASCII here, so that whole texts compare alike.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
BYTES = "".join(chr(i) for i in range(1, 32) if i not in (9, 10, 13))[: len(LETTERS)]


@query("d1_edit_distance", f""", b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS many, translate(text, '{LETTERS}', '{BYTES}') AS truth FROM benchmark), c AS (SELECT run_id, page, translate(text, '{LETTERS}', '{BYTES}') AS read FROM runs)
SELECT run_id, page, levenshtein(read, truth) AS edits, 1 - levenshtein(read, truth) / greatest(length(read), length(truth), 1) AS accuracy FROM c JOIN b ON place = run_id % many""")
def d1(spark, sf_dir):
    """Every turn against an item, items dealt by place so that each is reached."""
    items = core.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    many = items.agg(F.count("*")).scalar()
    dealt = tables.numbered(items, [], ["item_id"]).select((F.col("place") - 1).alias("place"), "truth")
    c = core.runs(spark, sf_dir).select("run_id", "page", F.col("text").alias("read"), F.pmod("run_id", many).alias("place"))
    j = c.join(dealt, "place")
    edits = F.levenshtein("read", "truth")
    return j.select("run_id", "page", edits.cast("long").alias("edits"), (1 - edits / F.greatest(F.length("read"), F.length("truth"), F.lit(1))).alias("accuracy"))


@query("q14_duplicate_lyrics", " SELECT score_id, line, verse, x // 24 AS note, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) > 1")
def q14(spark, sf_dir):
    """Notes (24 units of a line) that have two lyrics of one verse number."""
    return core.tokens(spark, sf_dir).groupBy("score_id", "line", "verse", F.floor(F.col("x") / 24).alias("note")).agg(F.count("*").alias("n")).where("n > 1")


@query("t3_title_pick", """, h AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS ord, t FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|title)>([^<]*)', 1)) AS t, generate_subscripts(regexp_extract_all(html, '<(?:h1|title)>([^<]*)', 1), 1) AS k FROM pages)),
s AS (SELECT *, 0.42::DOUBLE * length(t) / 100 + 0.33::DOUBLE * CASE WHEN length(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(t, '[^\\p{L}]', '', 'g')) ELSE 0 END AS score FROM h)
SELECT page_id, t AS title, score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1""")
def t3(spark, sf_dir):
    heads = core.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|title)>([^<]*)"), F.lit(1))).alias("ord", "t"))
    score = 0.42 * F.length("t") / 100 + 0.33 * text.uppercase_ratio(F.col("t"))
    return heads.withColumn("score", score).groupBy("page_id").agg(F.max(F.struct("score", -F.col("ord"), F.col("t"))).alias("b")).select("page_id", F.col("b.t").alias("title"), F.col("b.score").alias("score"))


@query("s4_natural_order", """, u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS name FROM pages)
SELECT page_id, list_aggregate(list_transform(regexp_extract_all(name, '(\\d+|\\D+)', 1), lambda r: CASE WHEN regexp_full_match(r, '\\d+') THEN lpad(length(ltrim(r, '0'))::VARCHAR, 6, '0') || ltrim(r, '0') ELSE r END), 'string_agg', '') AS sort_key FROM u""")
def s4(spark, sf_dir):
    return core.table(spark, sf_dir, "pages").select("page_id", text.natural_key(F.regexp_replace("url", "^[a-z]+://", "")).alias("sort_key"))


@query("s4_complete_pages", """, h AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS source, page_id FROM pages),
n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_id) + CASE WHEN page_id % 50 = 7 THEN 1 ELSE 0 END AS number FROM h)
SELECT source, count(*) AS pages, min(number) = 1 AND max(number) = count(*) AND count(DISTINCT number) = count(*) AS complete FROM n GROUP BY source""")
def s4_complete(spark, sf_dir):
    """Whether the pages of a host are numbered from 1 to their count; one in fifty has the number after its own."""
    h = core.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)/", 1).alias("source"), "page_id")
    n = tables.numbered(h, ["source"], ["page_id"])
    return files.complete_pages(n.select("source", (F.col("place") + F.when(F.col("page_id") % 50 == 7, 1).otherwise(0)).alias("number")))
