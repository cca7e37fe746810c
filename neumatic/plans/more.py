"""Further queries: markers, roles, candidates, gaps, samples, versions, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music, text
from ..operators import geometry, joins, lexicon, tables
from ..operators import measures as m
from ..operators.shared import beside, tasks_for
from ..registry import query
from . import core
from .measures import CARRIED
from .texts import SYMBOL, symbols


#: Chords and words of each measure; words go to the measures of their score in turn.
SHEET = """, per AS (SELECT score_id, count(*) AS n FROM measures GROUP BY ALL),
mw AS (SELECT t.score_id, 1 + pos % n AS measure_idx, string_agg(text, ' ' ORDER BY pos) AS words FROM tokens t JOIN per USING (score_id) GROUP BY ALL),
mc AS (SELECT score_id, measure_idx, string_agg('[' || step || CASE alter_by WHEN 1 THEN '#' WHEN -1 THEN 'b' ELSE '' END || ']', '' ORDER BY seq) AS chords FROM score_events WHERE kind = 'harmony' GROUP BY ALL),
sheet AS (SELECT m.score_id, m.measure_idx, coalesce(chords, '') AS chords, coalesce(words, '') AS words, m.measure_idx % 4 = 0 OR coalesce(regexp_matches(words, '[.!]$'), false) AS brk FROM measures m LEFT JOIN mw USING (score_id, measure_idx) LEFT JOIN mc USING (score_id, measure_idx)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM sheet)"""
INLINE = "string_agg(trim(chords || words), ' ' ORDER BY measure_idx)"


def sheet_lines(spark, sf_dir):
    """Measures with chords, words and the line that they print on: a line ends after every fourth measure and after . or !"""
    t, ms = core.tokens(spark, sf_dir), core.measures(spark, sf_dir)
    listed = lambda order, v, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, v.alias("v")))), lambda x: x["v"]), sep)
    n = ms.groupBy("score_id").agg(F.count("*").alias("n"))
    words = t.join(n, "score_id").groupBy("score_id", (1 + F.col("pos") % F.col("n")).alias("measure_idx")).agg(listed("pos", F.col("text"), " ").alias("words"))
    chord = F.concat(F.lit("["), "step", F.when(F.col("alter_by") == 1, "#").when(F.col("alter_by") == -1, "b").otherwise(""), F.lit("]"))
    chords = core.score_events(spark, sf_dir).where("kind = 'harmony'").groupBy("score_id", "measure_idx").agg(listed("seq", chord, "").alias("chords"))
    s = ms.select("score_id", "measure_idx").join(words, ["score_id", "measure_idx"], "left").join(chords, ["score_id", "measure_idx"], "left").na.fill("", ["words", "chords"])
    ends = (F.col("measure_idx") % 4 == 0) | F.col("words").rlike("[.!]$")
    before = Window.partitionBy("score_id").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("line", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))


def printed(lines, *pieces):
    """Text of each line from the pieces of its measures, lines joined by line breaks."""
    one = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", p.alias("v")))), lambda x: x["v"]), " ")
    each = lines.groupBy("score_id", "line").agg(F.array_join(F.array(*[one(p) for p in pieces]), "\n").alias("v"))
    return each.groupBy("score_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]), "\n").alias("sheet"))


@query("a13_measure_lists", SHEET + " SELECT score_id, measure_idx, chords, words FROM sheet")
def a13(spark, sf_dir):
    return sheet_lines(spark, sf_dir).select("score_id", "measure_idx", "chords", "words")


@query("w11_line_breaks", SHEET + " SELECT score_id, CAST(line AS BIGINT) AS line, min(measure_idx) AS first_measure, count(*) AS measures FROM numbered GROUP BY ALL")
def w11(spark, sf_dir):
    return sheet_lines(spark, sf_dir).groupBy("score_id", "line").agg(F.min("measure_idx").alias("first_measure"), F.count("*").alias("measures"))


@query("k3_lead_sheet", SHEET + f", l AS (SELECT score_id, line, {INLINE} AS v FROM numbered GROUP BY ALL) SELECT score_id, string_agg(v, chr(10) ORDER BY line) AS sheet FROM l GROUP BY ALL")
def k3(spark, sf_dir):
    return printed(sheet_lines(spark, sf_dir), F.trim(F.concat("chords", "words")))


@query("k3_lead_sheet_above", SHEET + """, l AS (SELECT score_id, line, string_agg(rpad(chords, CAST(greatest(length(chords), length(words)) AS INT), ' '), ' ' ORDER BY measure_idx) || chr(10) || string_agg(rpad(words, CAST(greatest(length(chords), length(words)) AS INT), ' '), ' ' ORDER BY measure_idx) AS v FROM numbered GROUP BY ALL)
SELECT score_id, string_agg(v, chr(10) ORDER BY line) AS sheet FROM l GROUP BY ALL""")
def k3_above(spark, sf_dir):
    wide = F.greatest(F.length("chords"), F.length("words"))
    return printed(sheet_lines(spark, sf_dir), F.rpad("chords", wide, F.lit(" ")), F.rpad("words", wide, F.lit(" ")))


@query("k4_chordpro", SHEET + f""", l AS (SELECT score_id, line, {INLINE} AS v FROM numbered GROUP BY ALL), b AS (SELECT score_id, string_agg(v, chr(10) ORDER BY line) AS body FROM l GROUP BY ALL)
SELECT score_id, '{{title: ' || title || '}}' || chr(10) || '{{book: ' || book || '}}' || chr(10) || '{{time: ' || coalesce(beats, 4) || '/' || coalesce(beat_type, 4) || '}}' || chr(10) || chr(10) || body AS song
FROM b JOIN scores USING (score_id) JOIN measures m USING (score_id) WHERE m.measure_idx = 1""")
def k4(spark, sf_dir):
    body = printed(sheet_lines(spark, sf_dir), F.trim(F.concat("chords", "words")))
    first = core.measures(spark, sf_dir).where("measure_idx = 1").select("score_id", "beats", "beat_type")
    j = body.join(core.scores(spark, sf_dir), "score_id").join(first, "score_id")
    line = lambda name, v: F.concat(F.lit(f"{{{name}: "), v, F.lit("}\n"))
    meter = F.concat(F.coalesce("beats", F.lit(4)), F.lit("/"), F.coalesce("beat_type", F.lit(4)))
    return j.select("score_id", F.concat(line("title", F.col("title")), line("book", F.col("book")), line("time", meter), F.lit("\n"), "sheet").alias("song"))


# The line under a heading; key names by fifths.
RULE = "═" * 59
MOVED_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(instr('C.D.EF.G.A.B', left({0}, 1)) - 1 + CASE WHEN {0}[2:2] = '#' THEN 1 WHEN {0}[2:2] = 'b' THEN -1 ELSE 0 END + 2 + 12) % 12 + 1]"
#: Chords (two semitones higher) and words of each measure, and the heading of each score.
TEXTS = SYMBOL.replace("SELECT measure_key, seq,", "SELECT score_id, measure_idx, measure_key, seq,") + CARRIED + f""", per AS (SELECT score_id, count(*) AS n FROM measures GROUP BY ALL),
mw AS (SELECT t.score_id, 1 + pos % n AS measure_idx, string_agg(trim(text), ' ' ORDER BY pos) AS words FROM tokens t JOIN per USING (score_id) WHERE trim(text) <> '' GROUP BY ALL),
mc AS (SELECT score_id, measure_idx, string_agg('[' || {MOVED_SQL.format('symbol')} || regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) || CASE WHEN contains(symbol, '/') THEN '/A' ELSE '' END || ']', ' ' ORDER BY seq) AS chords FROM sym GROUP BY ALL),
cells AS (SELECT m.score_id, m.measure_idx, coalesce(chords, '') AS chords, coalesce(words, '') AS words FROM measures m LEFT JOIN mw USING (score_id, measure_idx) LEFT JOIN mc USING (score_id, measure_idx)),
keys AS (SELECT score_id, ['Cb', 'Gb', 'Db', 'Ab', 'Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#', 'C#'][fifths + 8] AS k, coalesce(beats, 4) || '/' || coalesce(beat_type, 4) AS meter FROM carried WHERE measure_idx = 1),
heads AS (SELECT score_id, title, 'Composer ' || nation AS composer, {MOVED_SQL.format('k')} AS tone, meter FROM keys JOIN scores USING (score_id)),
headings AS (SELECT *, '[' || upper(title) || ']' || chr(10) || 'Sáng tác: ' || composer || chr(10) || 'Tone: [' || tone || '] - Nhịp: ' || meter || chr(10) || '{RULE}' || chr(10) || chr(10) AS heading FROM heads),
inline_ AS (SELECT score_id, line, trim(string_agg(concat_ws(' ', nullif(chords, ''), nullif(words, '')), ' ' ORDER BY measure_idx) FILTER (chords <> '' OR words <> '')) AS v FROM
  (SELECT *, coalesce(sum(CASE WHEN measure_idx % 4 = 0 OR regexp_matches(words, '[.!]$') THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM cells) GROUP BY ALL),
body AS (SELECT score_id, string_agg(coalesce(v, ''), chr(10) ORDER BY line) AS v FROM inline_ GROUP BY ALL)"""


def sheet_cells(spark, sf_dir, by=2):
    """score_id, measure_idx, chords (moved by semitones, in brackets), words."""
    t, ms = core.tokens(spark, sf_dir), core.measures(spark, sf_dir)
    listed = lambda order, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, v.alias("v")))), lambda x: x["v"]), " ")
    n = ms.groupBy("score_id").agg(F.count("*").alias("n"))
    words = t.where(F.trim("text") != "").join(n, "score_id").groupBy("score_id", (1 + F.col("pos") % F.col("n")).alias("measure_idx")).agg(listed("pos", F.trim("text")).alias("words"))
    chord = F.concat(F.lit("["), music.transposed_symbol(F.col("symbol"), by), F.lit("]"))
    chords = symbols(spark, sf_dir).groupBy("measure_key").agg(listed("seq", chord).alias("chords"))
    return ms.select("score_id", "measure_idx", "measure_key").join(words, ["score_id", "measure_idx"], "left").join(chords, "measure_key", "left").na.fill("", ["words", "chords"]).drop("measure_key")


def headings(spark, sf_dir, by=2):
    """score_id, title, composer, tone, meter."""
    c = m.carried(core.measures(spark, sf_dir)).where("measure_idx = 1")
    tone = music.transposed_symbol(F.get(F.array(*map(F.lit, music.KEYS)), (F.col("fifths") + 7).cast("int")), by)
    meter = F.concat(F.coalesce("beats", F.lit(4)), F.lit("/"), F.coalesce("beat_type", F.lit(4)))
    return c.join(core.scores(spark, sf_dir), "score_id").select("score_id", "title", F.concat(F.lit("Composer "), "nation").alias("composer"), tone.alias("tone"), meter.alias("meter"))


def heading():
    return F.concat(F.lit("["), F.upper("title"), F.lit("]\nSáng tác: "), "composer", F.lit("\nTone: ["), "tone", F.lit("] - Nhịp: "), "meter", F.lit(f"\n{RULE}\n\n"))


def joined_lines(order, value, sep):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]), sep)


def inline_body(cells):
    """A line ends after every fourth measure, and after words that end in . or !; a line may be empty."""
    ends = (F.col("measure_idx") % 4 == 0) | F.col("words").rlike("[.!]$")
    before = Window.partitionBy("score_id").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("line", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))
    both = F.concat_ws(" ", F.nullif("chords", F.lit("")), F.nullif("words", F.lit("")))
    lines = c.groupBy("score_id", "line").agg(F.trim(F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", F.nullif(both, F.lit("")).alias("v")))), lambda x: x["v"])), " ")).alias("v"))
    return lines.groupBy("score_id").agg(joined_lines("line", F.col("v"), "\n").alias("body"))


@query("k3_lead_sheet_text", TEXTS + " SELECT score_id, rtrim(heading || v, ' ' || chr(10)) AS sheet FROM headings JOIN body USING (score_id)")
def k3_text(spark, sf_dir):
    """Lead sheet two semitones higher, chords within the words."""
    return inline_body(sheet_cells(spark, sf_dir)).join(headings(spark, sf_dir), "score_id").select("score_id", F.rtrim(F.concat(heading(), "body"), F.lit(" \n")).alias("sheet"))


@query("k3_lead_sheet_text_above", TEXTS + """, filled AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(words, '[.!,]$') THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cells WHERE chords <> '' OR words <> ''),
placed AS (SELECT *, (row_number() OVER (PARTITION BY score_id, part ORDER BY measure_idx) - 1) // 4 AS four FROM filled),
two AS (SELECT score_id, min(measure_idx) AS begin_, string_agg(CASE WHEN chords = '' THEN repeat(' ', greatest(4, length(words))) ELSE chords END, '  ' ORDER BY measure_idx) || chr(10) || string_agg(CASE WHEN words = '' THEN repeat(' ', greatest(4, length(chords))) ELSE words END, ' ' ORDER BY measure_idx) AS v FROM placed GROUP BY score_id, part, four),
t AS (SELECT score_id, string_agg(v, chr(10) || chr(10) ORDER BY begin_) AS v FROM two GROUP BY score_id)
SELECT score_id, rtrim(heading || coalesce(v, ''), ' ' || chr(10)) AS sheet FROM headings LEFT JOIN t USING (score_id)""")
def k3_text_above(spark, sf_dir):
    """Chords above the words: a line of each for four measures that have something, or up to words that end in . ! or ,"""
    c = sheet_cells(spark, sf_dir).where("chords <> '' or words <> ''")
    order = Window.partitionBy("score_id").orderBy("measure_idx")
    c = c.withColumn("part", F.coalesce(F.sum(F.col("words").rlike("[.!,]$").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("four", F.floor((F.row_number().over(Window.partitionBy("score_id", "part").orderBy("measure_idx")) - 1) / 4))
    blank = lambda own, other: F.when(F.col(own) == "", F.repeat(F.lit(" "), F.greatest(F.lit(4), F.length(other)))).otherwise(F.col(own))
    two = c.groupBy("score_id", "part", "four").agg(F.min("measure_idx").alias("at"), F.concat(joined_lines("measure_idx", blank("chords", "words"), "  "), F.lit("\n"), joined_lines("measure_idx", blank("words", "chords"), " ")).alias("v"))
    body = two.groupBy("score_id").agg(joined_lines("at", F.col("v"), "\n\n").alias("body"))
    return headings(spark, sf_dir).join(body, "score_id", "left").select("score_id", F.rtrim(F.concat(heading(), F.coalesce("body", F.lit(""))), F.lit(" \n")).alias("sheet"))


@query("k4_chordpro_text", TEXTS + """ SELECT score_id, '{title: ' || title || '}' || chr(10) || '{composer: ' || composer || '}' || chr(10) || '{key: ' || tone || '}' || chr(10) || '{time: ' || meter || '}' || chr(10) || chr(10) || rtrim(heading || v, ' ' || chr(10)) AS song FROM headings JOIN body USING (score_id)""")
def k4_text(spark, sf_dir):
    """Directives, then the lead sheet."""
    j = inline_body(sheet_cells(spark, sf_dir)).join(headings(spark, sf_dir), "score_id")
    line = lambda name, c: F.concat(F.lit(f"{{{name}: "), c, F.lit("}\n"))
    return j.select("score_id", F.concat(line("title", "title"), line("composer", "composer"), line("key", "tone"), line("time", "meter"), F.lit("\n"), F.rtrim(F.concat(heading(), "body"), F.lit(" \n"))).alias("song"))


#: Variant of a score: which events it keeps.
VARIANTS = {"full": "true", "notation": "kind <> 'lyric'", "strict_notation": "kind NOT IN ('lyric', 'harmony')", "lyrics_only": "kind = 'lyric'", "chords_only": "kind = 'harmony'"}
EVENTS_AND_LYRICS = ", all_events AS (SELECT score_id, kind, measure_key AS place, seq AS n FROM score_events UNION ALL SELECT score_id, 'lyric', line, pos FROM tokens)"


@query("k6_variants", EVENTS_AND_LYRICS + " " + " UNION ALL ".join(f"SELECT score_id, '{v}' AS variant, count(*) AS events, CAST(sum(place * 31 + n) AS BIGINT) AS checksum FROM all_events WHERE {rule} GROUP BY score_id" for v, rule in VARIANTS.items()))
def k6(spark, sf_dir):
    e = core.score_events(spark, sf_dir).select("score_id", "kind", F.col("measure_key").alias("place"), F.col("seq").alias("n"))
    every = e.unionAll(core.tokens(spark, sf_dir).select("score_id", F.lit("lyric").alias("kind"), F.col("line").alias("place"), F.col("pos").alias("n")))
    each = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(v)) for v, rule in VARIANTS.items()]))
    return every.select("score_id", F.explode(each).alias("variant"), "place", "n").groupBy("score_id", "variant").agg(F.count("*").alias("events"), F.sum(F.col("place") * 31 + F.col("n")).alias("checksum"))


@query("k7_recognition_report", """, a AS (SELECT score_id, count(*) AS words, count(*) FILTER (confidence < 0.8) AS low, count(*) FILTER (confidence >= 0.55) AS accepted, count(DISTINCT line % 5 = 4) AS sections FROM tokens GROUP BY score_id), b AS (SELECT score_id, count(*) FILTER (kind = 'harmony') AS chords, count(*) FILTER (kind = 'note') AS n_notes, count(DISTINCT measure_key) AS n_measures FROM score_events GROUP BY score_id)
SELECT s.score_id, coalesce(words, 0) AS words, coalesce(low, 0) AS low, coalesce(accepted, 0) AS accepted, coalesce(words - accepted, 0) AS review, coalesce(sections, 0) AS sections, coalesce(chords, 0) AS chords, coalesce(n_notes, 0) AS n_notes, coalesce(n_measures, 0) AS n_measures, coalesce(words = accepted, true) AS aligned, false AS accuracy_available FROM scores s LEFT JOIN a USING (score_id) LEFT JOIN b USING (score_id)""")
def k7(spark, sf_dir):
    ok = F.count_if(F.col("confidence") >= 0.55)
    a = core.tokens(spark, sf_dir).groupBy("score_id").agg(F.count("*").alias("words"), F.count_if(F.col("confidence") < 0.8).alias("low"), ok.alias("accepted"), (F.count("*") - ok).alias("review"), F.countDistinct(F.col("line") % 5 == 4).alias("sections"))
    b = core.score_events(spark, sf_dir).groupBy("score_id").agg(F.count_if(F.col("kind") == "harmony").alias("chords"), F.count_if(F.col("kind") == "note").alias("n_notes"), F.countDistinct("measure_key").alias("n_measures"))
    r = core.scores(spark, sf_dir).select("score_id").join(a, "score_id", "left").join(b, "score_id", "left").na.fill(0)
    return r.withColumns({"aligned": F.col("review") == 0, "accuracy_available": F.lit(False)})


@query("k8_version_retention", """, v AS (SELECT score_id, event_id, "at" FROM review_log WHERE action IN ('edit', 'apply'))
SELECT score_id, arg_min(event_id, {'t': "at", 'e': event_id}) AS raw_version, arg_max(event_id, {'t': "at", 'e': event_id}) AS current_version FROM v GROUP BY score_id""")
def k8(spark, sf_dir):
    v = core.review_log(spark, sf_dir).where("action in ('edit', 'apply')")
    return v.groupBy("score_id").agg(F.min_by("event_id", F.struct("at", "event_id")).alias("raw_version"), F.max_by("event_id", F.struct("at", "event_id")).alias("current_version"))


#: Every sixteenth word of a score as a marker, by turns a verse number, a named verse, a chorus and an ending.
MARKED = """, marked AS (SELECT score_id, pos, CASE pos % 64 WHEN 0 THEN (1 + line % 9) || '.' WHEN 16 THEN 'Lời ' || (1 + line % 12) || ':' WHEN 32 THEN ['ĐK:', 'Điệp khúc', 'Chorus'][1 + line % 3] WHEN 48 THEN ['Coda', 'Kết', 'D.C.', 'Fine', 'Intro'][1 + line % 5] ELSE text END AS text FROM tokens)"""


def marked(spark, sf_dir):
    line, place = F.col("line"), F.col("pos") % 64
    one_of = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (line % len(names)).cast("int"))
    shown = F.when(place == 0, F.concat(1 + line % 9, F.lit("."))).when(place == 16, F.concat(F.lit("Lời "), 1 + line % 12, F.lit(":"))).when(place == 32, one_of(["ĐK:", "Điệp khúc", "Chorus"])).when(place == 48, one_of(["Coda", "Kết", "D.C.", "Fine", "Intro"])).otherwise(F.col("text"))
    return core.tokens(spark, sf_dir).withColumn("text", shown)


SECTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(trim(text), '{p.replace('(?iu)', '(?i)')}') THEN '{name}'" for name, p in text.SECTIONS.items()) + " END"


@query("x8_section_markers", MARKED + f""", p AS (SELECT score_id, pos, nullif(TRY_CAST(regexp_extract(trim(text), '{text.VERSE}', 1) AS INT), 0) AS verse_no, {SECTION_SQL} AS section FROM marked)
SELECT * FROM p WHERE verse_no IS NOT NULL OR section IS NOT NULL""")
def x8(spark, sf_dir):
    t = marked(spark, sf_dir).select("score_id", "pos", text.verse_number(F.col("text")).alias("verse_no"), text.section_marker(F.col("text")).alias("section"))
    return t.where("verse_no is not null or section is not null")


#: Lines of a score with every fifth line as chords, and marks of tempo, key and direction here and there.
LINES = """, lex AS (SELECT text AS word FROM tokens GROUP BY text HAVING count(DISTINCT score_id) >= 3),
lw AS (SELECT score_id, line, pos, CASE WHEN line % 5 = 2 AND length(text) <= 4 THEN upper(left(translate(text, 'éèêçóíñüöä', 'eeecoinuoa'), 1)) || 'm' WHEN line % 11 = 3 AND pos % 8 = 0 THEN ['Andante', '♩=80', 'Capo 2', 'D.C.', 'Fine', '12'][1 + line % 6] ELSE text END AS w, text FROM tokens),
lr AS (SELECT score_id, line, string_agg(w, ' ' ORDER BY pos) AS body, count(*) FILTER (regexp_full_match(w, '""" + music.CHORD.strip("^$") + """')) / count(*) AS chord_ratio, count(*) FILTER (lex.word IS NOT NULL) / count(*) AS word_ratio FROM lw LEFT JOIN lex ON lw.w = lex.word GROUP BY ALL)"""


def lines(spark, sf_dir):
    """Whole lines with their share of chords and of words that three scores or more have.

    Words that fewer scores have are brought to their texts. Chords and marks
    take the place of words, so for these it is looked up whether they are known.
    """
    marks = ["Andante", "♩=80", "Capo 2", "D.C.", "Fine", "12"]
    word = F.col("word")
    # a chord is the capital of a letter (up to three characters) and m
    counted = lexicon.counted(core.texts(spark, sf_dir, F.col("text")), 3, word.isin(*marks) | (word.endswith("m") & (F.length(word) <= 4)))
    signs = beside(counted.where("n >= 3").select("word"))
    d = core.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    t = lexicon.with_rare(d, counted.where("n < 3"), tasks_for(d, core.TEXTS_OF_TASK)).withColumnRenamed("doc_id", "score_id").withColumn("line", F.floor(F.col("pos") / 8))
    line = F.col("line")
    mark = F.get(F.array(*[F.lit(x) for x in marks]), (line % 6).cast("int"))
    chord = F.concat(F.upper(F.substring(F.translate("text", "éèêçóíñüöä", "eeecoinuoa"), 1, 1)), F.lit("m"))
    sign = F.when((line % 5 == 2) & (F.length("text") <= 4), chord).when((line % 11 == 3) & (F.col("pos") % 8 == 0), mark)
    t = t.select("score_id", "line", "pos", F.coalesce(sign, F.col("text")).alias("w"), sign.alias("sign"), "rare").join(signs, F.col("sign") == word, "left")
    known = F.when(F.col("sign").isNotNull(), word.isNotNull()).otherwise(~F.col("rare"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return t.groupBy("score_id", "line").agg(body.alias("body"), (F.count_if(F.col("w").rlike(music.CHORD)) / F.count("*")).alias("chord_ratio"), (F.count_if(known) / F.count("*")).alias("word_ratio"))


@query("x9_line_roles", LINES + f""" SELECT score_id, line, chord_ratio, word_ratio, {text.role_sql('body')} AS role FROM lr""")
def x9(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("role", text.line_role(F.col("body"), F.col("chord_ratio"), F.col("word_ratio"), F.lit("below"))).drop("body")


@query("x14_token_boxes", """, w AS (SELECT score_id, line, pos, text, sum(length(text) + 1) OVER (PARTITION BY score_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(length(text) + 1) OVER (PARTITION BY score_id, line) - 1 AS total FROM tokens)
SELECT score_id, pos, 1000.0 * coalesce(before, 0) / greatest(total, 1) AS x1, 1000.0 * (coalesce(before, 0) + length(text)) / greatest(total, 1) AS x2 FROM w""")
def x14(spark, sf_dir):
    w = Window.partitionBy("score_id", "line")
    size = F.length("text") + 1
    before = F.coalesce(F.sum(size).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.greatest(F.sum(size).over(w) - 1, F.lit(1))
    return core.tokens(spark, sf_dir).select("score_id", "pos", (1000.0 * before / total).alias("x1"), (1000.0 * (before + F.length("text")) / total).alias("x2"))


@query("x15_best_candidate", """, c AS (SELECT run_id, page, engine, text, (length(text) % 101) / 100.0 AS confidence FROM runs) SELECT run_id, arg_max(engine, {'c': confidence, 'p': -page}) AS engine, max(confidence) AS confidence FROM c GROUP BY run_id""")
def x15(spark, sf_dir):
    c = core.runs(spark, sf_dir).withColumn("confidence", (F.length("text") % 101) / 100.0)
    return c.groupBy("run_id").agg(F.max_by("engine", F.struct("confidence", -F.col("page"))).alias("engine"), F.max("confidence").alias("confidence"))


@query("x18_comparison_tokens", r" SELECT conv_id AS run_id, turn AS page, len(list_filter(string_split(regexp_replace(lower(text), '[^\p{L} ]', '', 'g'), ' '), lambda x: x <> '')) AS n FROM conversations")
def x18(spark, sf_dir):
    return core.runs(spark, sf_dir).select("run_id", "page", F.size(text.comparison_tokens(F.col("text"))).cast("long").alias("n"))


STAVES = """, staves AS (SELECT score_id, measure_key, measure_idx, 90.0 * measure_idx + measure_key % 40 AS top, 90.0 * measure_idx + measure_key % 40 + 4 * (5 + measure_key % 4) AS bottom, 5.0 + measure_key % 4 AS interline, measure_key % 5 = 0 AS linked FROM measures)"""


def staves(spark, sf_dir):
    """A staff per measure: top and bottom line, interline, and whether a bar line links it to the staff before."""
    k, i = F.col("measure_key"), F.col("measure_idx")
    top, interline = 90.0 * i + k % 40, 5.0 + k % 4
    return core.measures(spark, sf_dir).select("score_id", "measure_key", "measure_idx", top.alias("top"), (top + 4 * interline).alias("bottom"), interline.alias("interline"), (k % 5 == 0).alias("linked"))


@query("w9_system_groups", STAVES + """, g AS (SELECT *, lag(bottom) OVER w AS above, greatest(interline, lag(interline) OVER w) AS wide FROM staves WINDOW w AS (PARTITION BY score_id ORDER BY top, measure_key))
SELECT measure_key, CAST(1 + sum(CASE WHEN top - above > 7 * wide AND NOT linked THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY top, measure_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS system FROM g""")
def w9(spark, sf_dir):
    return geometry.systems(staves(spark, sf_dir), ["score_id"]).select("measure_key", "system")


@query("w16_sequence_ids", " SELECT score_id, 'p' || (page + 1) || '-w' || n AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY score_id, page ORDER BY pos) AS n FROM tokens) WHERE trim(text, ' ') <> ''")
def w16(spark, sf_dir):
    t = core.tokens(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("score_id", "page").orderBy("pos")))
    return t.where(F.trim("text") != "").select("score_id", F.concat(F.lit("p"), F.col("page") + 1, F.lit("-w"), "n").alias("id"), "text")


@query("t6_largest_gaps", """, g AS (SELECT score_id, line, pos, lead(x) OVER (PARTITION BY score_id, line ORDER BY pos) - x AS gap, 2 + line % 5 AS n FROM tokens), r AS (SELECT *, row_number() OVER (PARTITION BY score_id, line ORDER BY gap DESC, pos) AS k, count(*) OVER (PARTITION BY score_id, line) AS many FROM g WHERE gap >= 0.35 * 24)
SELECT score_id, line, pos, gap FROM r WHERE many >= n - 1 AND k <= n - 1""")
def t6(spark, sf_dir):
    """The count - 1 widest gaps of each line, none of a line that has too few of 0.35 heights."""
    w = Window.partitionBy("score_id", "line")
    g = core.tokens(spark, sf_dir).withColumn("gap", F.lead("x").over(w.orderBy("pos")) - F.col("x")).where(F.col("gap") >= 0.35 * 24)
    wanted = 1 + F.col("line") % 5
    g = g.withColumns({"k": F.row_number().over(w.orderBy(F.desc("gap"), "pos")), "many": F.count("*").over(w)})
    return g.where((F.col("many") >= wanted) & (F.col("k") <= wanted)).select("score_id", "line", "pos", "gap")


@query("a11_anchor_median", """, s AS (SELECT lang AS book, score_id, line, text, confidence, row_number() OVER (PARTITION BY lang, score_id, line ORDER BY pos) AS nth FROM tokens) SELECT book, median(confidence) AS anchor FROM s WHERE nth = 1 GROUP BY book""")
def a11(spark, sf_dir):
    t = core.tokens(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "score_id", "line").orderBy("pos")))
    return t.where("nth = 1").groupBy(F.col("lang").alias("book")).agg(F.median("confidence").alias("anchor"))


@query("a22_note_equality", CARRIED + """, a AS (SELECT measure_key, string_agg(step || alter_by || octave || ':' || duration, ' ' ORDER BY seq) AS expected FROM notes WHERE NOT is_rest GROUP BY ALL),
b AS (SELECT measure_key, string_agg(step || CASE WHEN measure_key % 9 = 0 THEN 0 ELSE alter_by END || octave || ':' || duration, ' ' ORDER BY seq) AS actual FROM notes WHERE NOT is_rest GROUP BY ALL)
SELECT measure_key, expected = actual AS equal FROM a JOIN b USING (measure_key)""")
def a22(spark, sf_dir):
    n = core.notes(spark, sf_dir).where("not is_rest")
    listed = lambda alter: F.array_sort(F.collect_list(F.struct("seq", "step", alter, "octave", "duration")))
    changed = F.when(F.col("measure_key") % 9 == 0, 0).otherwise(F.col("alter_by"))
    both = n.groupBy("measure_key").agg(listed(F.col("alter_by").alias("a")).alias("expected"), listed(changed.alias("a")).alias("actual"))
    return both.select("measure_key", (F.col("expected") == F.col("actual")).alias("equal"))


@query("j8_line_in_band", """, bands AS (SELECT score_id, measure_idx, k, 10 * measure_idx + [0, 4, 8][k] AS y1, 10 * measure_idx + [6, 10, 15][k] AS y2 FROM measures, range(1, 4) t(k)), l AS (SELECT score_id, line, 7 * line AS cy FROM tokens GROUP BY ALL)
SELECT l.score_id, l.line, min(measure_idx * 4 + k) // 4 AS system, ['above', 'between', 'below'][min(measure_idx * 4 + k) % 4] AS band FROM l JOIN bands b ON l.score_id = b.score_id AND l.cy >= b.y1 AND l.cy < b.y2 GROUP BY ALL""")
def j8(spark, sf_dir):
    """First band of each line: by system, and above, between, below in it."""
    i = F.col("measure_idx")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("band"), (10 * i + a).alias("y1"), (10 * i + b).alias("y2")) for k, name, a, b in ((1, "above", 0, 6), (2, "between", 4, 10), (3, "below", 8, 15))])
    bands = core.measures(spark, sf_dir).select("score_id", F.col("measure_idx").alias("system"), F.explode(kinds).alias("b")).select("score_id", "system", "b.k", "b.band", "b.y1", "b.y2")
    lines = core.tokens(spark, sf_dir).select("score_id", "line").distinct().withColumn("cy", 7 * F.col("line"))
    found = joins.contained(lines, bands, ["score_id"], "cy", "y1", "y2", 10.0)
    return found.groupBy("score_id", "line").agg(F.min(F.struct("system", "k", "band")).alias("b")).select("score_id", "line", "b.system", "b.band")


HASHES = """, hashes AS (SELECT score_id, measure_idx AS measure_no, sha256(string_agg(kind || step || octave || ':' || duration, ' ' ORDER BY seq)) AS xml_sha256 FROM score_events GROUP BY ALL),
decisions AS (SELECT l.*, CASE WHEN event_id % 5 = 0 THEN sha256(xml_sha256) ELSE xml_sha256 END AS decided_sha256 FROM review_log l LEFT JOIN hashes h ON l.score_id = h.score_id AND l.measure_no = h.measure_no)"""


def hashes(spark, sf_dir):
    """SHA-256 of what each measure holds now."""
    part = F.concat("kind", "step", "octave", F.lit(":"), "duration")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), " ")
    return core.score_events(spark, sf_dir).groupBy("score_id", F.col("measure_idx").alias("measure_no")).agg(F.sha2(body, 256).alias("xml_sha256"))


def decisions(spark, sf_dir):
    """The log with the hash that each event saw; every fifth saw another version."""
    j = core.review_log(spark, sf_dir).join(hashes(spark, sf_dir), ["score_id", "measure_no"], "left")
    return j.withColumn("decided_sha256", F.when(F.col("event_id") % 5 == 0, F.sha2("xml_sha256", 256)).otherwise(F.col("xml_sha256")))


@query("j22_decision_hash", HASHES + """, d AS (SELECT score_id, measure_no, arg_max(action, {'t': "at", 'e': event_id}) AS action, arg_max(coalesce(decided_sha256, ''), {'t': "at", 'e': event_id}) AS decided FROM decisions GROUP BY ALL)
SELECT d.score_id, d.measure_no, CASE WHEN decided = xml_sha256 THEN action ELSE 'open' END AS status FROM d LEFT JOIN hashes h ON d.score_id = h.score_id AND d.measure_no = h.measure_no""")
def j22(spark, sf_dir):
    at = F.struct("at", "event_id")
    d = decisions(spark, sf_dir).groupBy("score_id", "measure_no").agg(F.max_by("action", at).alias("action"), F.max_by(F.coalesce("decided_sha256", F.lit("")), at).alias("decided"))
    j = d.join(hashes(spark, sf_dir), ["score_id", "measure_no"], "left")
    return j.select("score_id", "measure_no", F.when(F.col("decided") == F.col("xml_sha256"), F.col("action")).otherwise("open").alias("status"))


@query("r2_stale_events", HASHES + """, l AS (SELECT score_id, measure_no, event_id, decided_sha256, lag(CASE WHEN action IN ('edit', 'apply') THEN sha256(coalesce(decided_sha256, '') || event_id) ELSE decided_sha256 END) OVER (PARTITION BY score_id, measure_no ORDER BY "at", event_id) AS current_sha256 FROM decisions)
SELECT event_id, coalesce(current_sha256 IS NULL OR decided_sha256 = current_sha256, false) AS valid FROM l WHERE decided_sha256 IS NOT NULL""")
def r2(spark, sf_dir):
    """An event counts only if the hash it saw is the one after the event before it; edits make a new hash."""
    w = Window.partitionBy("score_id", "measure_no").orderBy("at", "event_id")
    after = F.when(F.col("action").isin("edit", "apply"), F.sha2(F.concat(F.coalesce("decided_sha256", F.lit("")), "event_id"), 256)).otherwise(F.col("decided_sha256"))
    l = decisions(spark, sf_dir).withColumn("current", F.lag(after).over(w)).where("decided_sha256 is not null")
    return l.select("event_id", F.coalesce(F.col("current").isNull() | (F.col("decided_sha256") == F.col("current")), F.lit(False)).alias("valid"))


SYSTEMS = """, sys AS (SELECT run_id, 'mine' AS engine, page // 2 AS system, page AS measure FROM runs UNION ALL SELECT run_id, 'theirs', page // 2, page FROM runs WHERE NOT (engine = 'system' AND page % 3 = 0)),
per_system AS (SELECT run_id, engine, system, count(*) AS n FROM sys GROUP BY ALL),
lists AS (SELECT run_id, engine, string_agg(n::VARCHAR, ',' ORDER BY system) AS s FROM per_system GROUP BY ALL),
agree AS (SELECT a.run_id, coalesce(a.s = b.s, false) AS agree FROM lists a LEFT JOIN lists b ON a.run_id = b.run_id AND b.engine = 'theirs' WHERE a.engine = 'mine'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, engine ORDER BY system, measure) AS ordinal FROM sys)"""


def by_system(spark, sf_dir):
    r = core.runs(spark, sf_dir).select("run_id", F.floor(F.col("page") / 2).alias("system"), F.col("page").alias("measure"), "engine")
    return r.drop("engine"), r.where("not (engine = 'system' and measure % 3 = 0)").drop("engine")


@query("j29_engine_agreement", SYSTEMS + " SELECT run_id, agree FROM agree")
def j29(spark, sf_dir):
    return joins.agreement(*by_system(spark, sf_dir), "run_id", "system")


@query("j29_mapped_measures", SYSTEMS + " SELECT a.run_id, a.measure, b.measure AS other FROM ranked a JOIN ranked b ON a.run_id = b.run_id AND a.ordinal = b.ordinal JOIN agree g ON g.run_id = a.run_id WHERE agree AND a.engine = 'mine' AND b.engine = 'theirs'")
def j29_mapped(spark, sf_dir):
    """Where the engines agree on measures per system, the k-th measure of one is the k-th of the other."""
    mine, theirs = by_system(spark, sf_dir)
    agree = joins.agreement(mine, theirs, "run_id", "system").where("agree").select("run_id")
    pairs = joins.positional(mine, theirs.select("run_id", F.col("system").alias("other_system"), F.col("measure").alias("other")), ["run_id"], ["system", "measure"], ["other_system", "other"])
    return pairs.join(agree, "run_id").where("measure is not null and other is not null").select("run_id", "measure", "other")


@query("p14_chord_text", SYMBOL + """, parts AS (SELECT measure_key, seq, left(symbol, 1) AS step, CASE regexp_extract(symbol, '^[A-G]([#b]?)', 1) WHEN '#' THEN '♯' WHEN 'b' THEN '♭' ELSE '' END AS accidental, CASE regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) WHEN 'x' THEN '' ELSE regexp_extract(symbol, '^[A-G][#b]?([^/]*)', 1) END AS quality, nullif(regexp_extract(symbol, '/([A-G])', 1), '') AS bass FROM sym)
SELECT measure_key, seq, step || accidental || quality || coalesce('/' || bass, '') AS shown FROM parts""")
def p14(spark, sf_dir):
    """What P11 made of a symbol, as text again; a kind that is not known shows as its root."""
    return symbols(spark, sf_dir).select("measure_key", "seq", music.chord_text(music.chord_parts(F.col("symbol"))).alias("shown"))


HEADER = CARRIED + """, header AS (SELECT c.score_id, s.title, nation, coalesce(c.beats, 4) AS beats, coalesce(c.beat_type, 4) AS beat_type, c.fifths FROM carried c JOIN scores s USING (score_id) WHERE c.measure_idx = 1)"""


@query("p22_score_header", HEADER + " SELECT score_id, title, 'Composer ' || nation AS composer, beats || '/' || beat_type AS meter, ['Cb', 'Gb', 'Db', 'Ab', 'Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#', 'C#'][fifths + 8] || ' major' AS key_name, fifths FROM header")
def p22(spark, sf_dir):
    c = m.carried(core.measures(spark, sf_dir)).where("measure_idx = 1")
    meter = F.concat(F.coalesce("beats", F.lit(4)), F.lit("/"), F.coalesce("beat_type", F.lit(4)))
    return c.join(core.scores(spark, sf_dir), "score_id").select("score_id", "title", F.concat(F.lit("Composer "), "nation").alias("composer"), meter.alias("meter"), music.key_name(F.col("fifths")).alias("key_name"), "fifths")


LIBRARY = ", library AS (SELECT *, 'Composer ' || nation AS composer, CASE WHEN balance < 0 THEN 'failed' WHEN balance < 3000 THEN 'needs_review' WHEN balance < 8000 THEN 'Ready' ELSE 'queued' END AS raw_status FROM scores)"


def library(spark, sf_dir):
    status = F.when(F.col("balance") < 0, "failed").when(F.col("balance") < 3000, "needs_review").when(F.col("balance") < 8000, "Ready").otherwise("queued")
    return core.scores(spark, sf_dir).withColumns({"composer": F.concat(F.lit("Composer "), "nation"), "raw_status": status})


@query("p27_status", LIBRARY + " SELECT score_id, CASE WHEN upper(raw_status) IN ('READY', 'NEEDS_REVIEW', 'FAILED') THEN upper(raw_status) ELSE 'PROCESSING' END AS status FROM library")
def p27(spark, sf_dir):
    return library(spark, sf_dir).select("score_id", text.status(F.col("raw_status")).alias("status"))


@query("p26_library_search", LIBRARY + " SELECT score_id, title FROM library WHERE book = 'BUILDING' AND upper(raw_status) = 'READY' AND (contains(lower(title), '0012') OR contains(lower(composer), 'composer 7') OR contains(CAST(score_id AS VARCHAR), '77'))")
def p26(spark, sf_dir):
    s = library(spark, sf_dir).where((F.col("book") == "BUILDING") & (text.status(F.col("raw_status")) == "READY"))
    return s.where(F.lower("title").contains("0012") | F.lower("composer").contains("composer 7") | F.col("score_id").cast("string").contains("77")).select("score_id", "title")


@query("t2_library_order", LIBRARY + " SELECT score_id, row_number() OVER (PARTITION BY book ORDER BY balance DESC, score_id) AS place FROM library")
def t2(spark, sf_dir):
    """Newest first; balance stands for the time of creation."""
    s = library(spark, sf_dir).withColumn("age", -F.col("balance"))
    return tables.numbered(s.select("book", "age", "score_id"), ["book"], ["age", "score_id"]).select("score_id", "place")


@query("p18_quantise", " SELECT measure_key, seq, (SELECT v FROM (VALUES (0.25), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0), (4.0), (6.0), (8.0)) t(v) ORDER BY abs(duration * 0.7 - v), v LIMIT 1)::DOUBLE AS length FROM notes")
def p18(spark, sf_dir):
    return core.notes(spark, sf_dir).select("measure_key", "seq", music.quantised(F.col("duration") * F.lit(0.7)).alias("length"))
