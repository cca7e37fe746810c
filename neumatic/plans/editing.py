"""Queries over edits: voices, chords typed by hand, note edits, checks, artifacts, merges, backfill."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import joins
from ..registry import query
from . import core
from .measures import CARRIED, SUNG
from .more import HASHES, hashes
from .texts import SYMBOL, symbols


@query("p3_primary_voice", " SELECT measure_key, seq FROM (SELECT *, max(CASE WHEN voice = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY measure_key) AS has FROM notes) WHERE has = 0 OR voice = 1")
def p3(spark, sf_dir):
    """Voice 1 of the measures that have it, else all voices."""
    has = F.max((F.col("voice") == 1).cast("int")).over(Window.partitionBy("measure_key"))
    return core.notes(spark, sf_dir).withColumn("has", has).where("has = 0 or voice = 1").select("measure_key", "seq")


# Qualities of the lenient parser beyond the strict ones, and kinds that a score may hold.
LENIENT = {"": "major", "M": "major", "maj": "major", "m": "minor", "min": "minor", "7": "dominant", "dom7": "dominant", "maj7": "major-seventh", "M7": "major-seventh", "Δ": "major-seventh", "m7": "minor-seventh", "min7": "minor-seventh", "m7b5": "half-diminished", "ø": "half-diminished", "dim": "diminished", "o": "diminished", "dim7": "diminished-seventh", "o7": "diminished-seventh", "aug": "augmented", "+": "augmented", "sus2": "suspended-second", "sus4": "suspended-fourth", "sus": "suspended-fourth", "add9": "major", "9": "dominant-ninth", "maj9": "major-ninth", "M9": "major-ninth", "m9": "minor-ninth", "11": "dominant-11th", "13": "dominant-13th"}
ALLOWED = "major minor augmented diminished dominant major-seventh minor-seventh diminished-seventh augmented-seventh half-diminished major-minor major-sixth minor-sixth dominant-ninth major-ninth minor-ninth dominant-11th major-11th minor-11th dominant-13th major-13th minor-13th suspended-second suspended-fourth Neapolitan Italian French German pedal power Tristan other none".split()

#: Symbols as people type them: lower-case roots, qualities that the strict grammar does not know.
TYPED = SYMBOL + """, typed AS (SELECT measure_key, seq, CASE seq % 5 WHEN 0 THEN lower(left(symbol, 1)) || substr(symbol, 2) WHEN 1 THEN ' ' || symbol WHEN 2 THEN replace(symbol, 'x', 'm7sus') WHEN 3 THEN replace(symbol, 'maj7', 'Δ') ELSE symbol END AS t FROM sym)"""


def typed(spark, sf_dir):
    k, s = F.col("seq") % 5, F.col("symbol")
    t = F.when(k == 0, F.concat(F.lower(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))).when(k == 1, F.concat(F.lit(" "), s)).when(k == 2, F.replace(s, F.lit("x"), F.lit("m7sus"))).when(k == 3, F.replace(s, F.lit("maj7"), F.lit("Δ"))).otherwise(s)
    return symbols(spark, sf_dir).select("measure_key", "seq", t.alias("t"))


@query("p12_lenient_chords", TYPED + """, p AS (SELECT *, split_part(trim(t), '/', 1) AS main, split_part(trim(t), '/', 2) AS bass FROM typed), q AS (SELECT *, CASE substr(main, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 END AS alter_by, substr(main, CASE WHEN substr(main, 2, 1) IN ('#', 'b') THEN 3 ELSE 2 END) AS quality FROM p)
SELECT measure_key, seq, upper(left(main, 1)) AS step, alter_by, CASE """ + " ".join(f"WHEN quality = '{q}' THEN '{k}'" for q, k in LENIENT.items()) + """ WHEN quality LIKE 'm%' AND contains(quality, '7') THEN 'minor-seventh' ELSE 'major' END AS kind, nullif(upper(left(bass, 1)), '') AS bass_step FROM q""")
def p12(spark, sf_dir):
    """Never fails: an unknown quality is major, one of m and 7 a minor seventh."""
    main, bass = F.split_part(F.trim("t"), F.lit("/"), F.lit(1)), F.split_part(F.trim("t"), F.lit("/"), F.lit(2))
    t = typed(spark, sf_dir).select("measure_key", "seq", main.alias("main"), bass.alias("bass")).withColumn("sign", F.substring("main", 2, 1))
    t = t.withColumn("quality", F.substr(F.col("main"), F.when(F.col("sign").isin("#", "b"), 3).otherwise(2)))
    other = F.when(F.col("quality").startswith("m") & F.col("quality").contains("7"), "minor-seventh").otherwise("major")
    return t.select("measure_key", "seq", F.upper(F.left("main", F.lit(1))).alias("step"), F.when(F.col("sign") == "#", 1).when(F.col("sign") == "b", -1).alias("alter_by"), music.lookup(LENIENT, F.col("quality"), other).alias("kind"), F.nullif(F.upper(F.left("bass", F.lit(1))), F.lit("")).alias("bass_step"))


# Fixed pattern: chords as the editor takes them.
EDITOR = r"^([A-Ga-g])([#♯b♭]?)(.*?)(?:/([A-Ga-g])([#♯b♭]?))?$"


@query("p13_editor_chords", TYPED + f""", p AS (SELECT measure_key, seq, trim(t) AS t FROM typed), q AS (SELECT *, regexp_extract(t, '{EDITOR}', 3) AS kind, regexp_extract(t, '{EDITOR}', 2) AS sign FROM p WHERE regexp_full_match(t, '{EDITOR}'))
SELECT measure_key, seq, upper(left(t, 1)) AS step, CASE WHEN sign IN ('#', '♯') THEN 1 WHEN sign IN ('b', '♭') THEN -1 ELSE 0 END AS alter_by, CASE WHEN kind = 'm' OR kind LIKE 'min%' THEN 'minor' WHEN kind LIKE '7%' THEN 'dominant' ELSE 'major' END AS kind, nullif(upper(regexp_extract(t, '{EDITOR}', 4)), '') AS bass_step FROM q""")
def p13(spark, sf_dir):
    t = typed(spark, sf_dir).withColumn("t", F.trim("t")).where(F.col("t").rlike(EDITOR))
    part = lambda i: F.regexp_extract("t", EDITOR, i)
    kind = F.when((part(3) == "m") | part(3).startswith("min"), "minor").when(part(3).startswith("7"), "dominant").otherwise("major")
    return t.select("measure_key", "seq", F.upper(part(1)).alias("step"), F.when(part(2).isin("#", "♯"), 1).when(part(2).isin("b", "♭"), -1).otherwise(0).alias("alter_by"), kind.alias("kind"), F.nullif(F.upper(part(4)), F.lit("")).alias("bass_step"))


NOTE_EDITS = CARRIED + """, e AS (SELECT n.measure_key, n.seq, c.divisions, ['whole', 'half', 'quarter', 'eighth', '16th'][1 + n.seq % 5] AS type, n.seq % 3 = 0 AS dot, [NULL, 'sharp', 'flat', 'natural'][1 + n.seq % 4] AS accidental, n.seq % 7 = 5 AS toggled, n.is_rest, n.alter_by FROM notes n JOIN carried c USING (measure_key))"""


@query("p19_note_edits", NOTE_EDITS + " SELECT measure_key, seq, greatest(1, round(divisions * CASE type WHEN 'whole' THEN 4 WHEN 'half' THEN 2 WHEN 'quarter' THEN 1 WHEN 'eighth' THEN 0.5 ELSE 0.25 END * CASE WHEN dot THEN 1.5 ELSE 1 END))::BIGINT AS duration, CASE accidental WHEN 'sharp' THEN 1 WHEN 'flat' THEN -1 WHEN 'natural' THEN 0 ELSE alter_by END AS alter_by, is_rest <> toggled AS is_rest FROM e")
def p19(spark, sf_dir):
    """Type and dot give the duration in divisions, an accidental the alteration; some edits turn notes into rests and back."""
    from ..operators.measures import carried

    n = core.notes(spark, sf_dir).join(carried(core.measures(spark, sf_dir)).select("measure_key", "divisions"), "measure_key")
    k = F.col("seq")
    of = lambda m, items: F.get(F.array(*[F.lit(x) for x in items]), (k % m).cast("int"))
    return n.select("measure_key", "seq", music.edited_duration(of(5, ["whole", "half", "quarter", "eighth", "16th"]), k % 3 == 0, F.col("divisions")).alias("duration"), music.edited_alteration(of(4, [None, "sharp", "flat", "natural"]), F.col("alter_by")).alias("alter_by"), (F.col("is_rest") != (k % 7 == 5)).alias("is_rest"))


@query("p21_pitch_sanity", TYPED + f""", c AS (SELECT measure_key, seq, left(trim(t), 1) AS root, CASE WHEN seq % 6 = 1 THEN 'strange' ELSE 'minor' END AS kind FROM typed), n AS (SELECT measure_key, seq, octave * (CASE WHEN seq % 6 = 0 THEN 3 ELSE 1 END) AS octave FROM notes)
SELECT measure_key, seq, 'invalid_harmony_root' AS issue FROM c WHERE root NOT IN ('A', 'B', 'C', 'D', 'E', 'F', 'G') UNION ALL SELECT measure_key, seq, 'invalid_harmony_kind' FROM c WHERE kind NOT IN ({", ".join(f"'{k}'" for k in ALLOWED)}) UNION ALL SELECT measure_key, seq, 'pitch_out_of_range' FROM n WHERE octave NOT BETWEEN 0 AND 9""")
def p21(spark, sf_dir):
    c = typed(spark, sf_dir).select("measure_key", "seq", F.left(F.trim("t"), F.lit(1)).alias("root"), F.when(F.col("seq") % 6 == 1, "strange").otherwise("minor").alias("kind"))
    n = core.notes(spark, sf_dir).select("measure_key", "seq", (F.col("octave") * F.when(F.col("seq") % 6 == 0, 3).otherwise(1)).alias("octave"))
    found = F.array_compact(F.array(F.when(~F.col("root").isin(list("ABCDEFG")), "invalid_harmony_root"), F.when(~F.col("kind").isin(ALLOWED), "invalid_harmony_kind")))
    high = n.where(~F.col("octave").between(0, 9)).select("measure_key", "seq", F.lit("pitch_out_of_range").alias("issue"))
    return c.select("measure_key", "seq", F.explode(found).alias("issue")).unionAll(high)


@query("p28_header_overwrite", """, e AS (SELECT score_id, title || ' (new)' AS title, 3 AS beats FROM scores WHERE score_id % 4 = 1)
SELECT m.measure_key, coalesce(e.title, s.title) AS title, CASE WHEN m.measure_idx = 1 AND e.beats IS NOT NULL THEN e.beats ELSE m.beats END AS beats FROM measures m JOIN scores s USING (score_id) LEFT JOIN e USING (score_id)""")
def p28(spark, sf_dir):
    """Edits of a score overwrite its title, and the meter of its first measure only."""
    s = core.scores(spark, sf_dir)
    e = s.where("score_id % 4 = 1").select("score_id", F.concat("title", F.lit(" (new)")).alias("new_title"), F.lit(3).cast("long").alias("new_beats"))
    j = core.measures(spark, sf_dir).join(s.select("score_id", "title"), "score_id").join(e, "score_id", "left")
    return j.select("measure_key", F.coalesce("new_title", "title").alias("title"), F.when((F.col("measure_idx") == 1) & F.col("new_beats").isNotNull(), F.col("new_beats")).otherwise(F.col("beats")).alias("beats"))


# Page credit of each header field.
CREDITS = {"title": "title", "composer": "composer", "lyricist": "lyricist", "collection": "subtitle", "hymn_number": "title-number", "description": "subtitle", "scripture_reference": "subtitle", "translator": "lyricist", "tempo": "subtitle", "key_info": "subtitle", "note": "subtitle"}


@query("k9_page_credits", ", f AS (SELECT score_id, unnest([" + ", ".join(f"'{r}'" for r in CREDITS) + "]) AS role, generate_subscripts([" + ", ".join(f"'{r}'" for r in CREDITS) + "], 1) AS k, title FROM scores) SELECT score_id, role, CASE role " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in CREDITS.items()) + " END AS credit_type, CASE WHEN role IN ('collection', 'hymn_number') THEN 'left' ELSE 'center' END AS justify, round((100.0 * k + (100.0 * k + 50 + score_id % 30)) / 2 * (10 / 8.0), 2) AS x, round((2000 - (20.0 * k + (20.0 * k + 15)) / 2) * (10 / 8.0), 2) AS y FROM f WHERE (score_id + k) % 4 <> 0")
def k9(spark, sf_dir):
    """Fields that have text, as credits in tenths of a staff space of 8 pixels, y from the foot of a page of 2000."""
    f = core.scores(spark, sf_dir).select("score_id", F.posexplode(F.array(*[F.lit(r) for r in CREDITS])).alias("k", "role")).withColumn("k", F.col("k") + 1).where("(score_id + k) % 4 <> 0")
    x1, y1, tenths = 100.0 * F.col("k"), 20.0 * F.col("k"), 10 / 8.0
    side = F.when(F.col("role").isin("collection", "hymn_number"), "left").otherwise("center")
    return f.select("score_id", "role", music.lookup(CREDITS, F.col("role")).alias("credit_type"), side.alias("justify"), F.round((x1 + (x1 + 50 + F.col("score_id") % 30)) / 2 * tenths, 2).alias("x"), F.round((2000 - (y1 + (y1 + 15)) / 2) * tenths, 2).alias("y"))


@query("j17_merged_elements", """, a AS (SELECT measure_key, measure_idx, score_id, seq, md5(kind || step || octave || duration) AS h FROM score_events WHERE kind = 'harmony'), mine AS (SELECT score_id, measure_idx, h FROM a WHERE seq % 3 <> 0), other AS (SELECT DISTINCT score_id, measure_idx + CAST(measure_idx % 2 AS BIGINT) AS measure_idx, h FROM a)
SELECT 'kept' AS origin, score_id, measure_idx, h FROM mine UNION ALL SELECT 'added', o.* FROM other o WHERE EXISTS (SELECT 1 FROM measures m WHERE m.score_id = o.score_id AND m.measure_idx = o.measure_idx) AND NOT EXISTS (SELECT 1 FROM mine WHERE mine.score_id = o.score_id AND mine.measure_idx = o.measure_idx AND mine.h = o.h)""")
def j17(spark, sf_dir):
    """Chords of another run are added to the measure of the same part and number, unless the same is there."""
    a = core.score_events(spark, sf_dir).where("kind = 'harmony'").select("score_id", "measure_idx", "seq", F.md5(F.concat("kind", "step", "octave", "duration")).alias("h"))
    mine, other = a.where("seq % 3 <> 0").drop("seq"), a.select("score_id", (F.col("measure_idx") + F.col("measure_idx") % 2).alias("measure_idx"), "h").distinct()
    added = other.join(core.measures(spark, sf_dir), ["score_id", "measure_idx"], "left_semi").join(mine, ["score_id", "measure_idx", "h"], "left_anti")
    of = lambda f, name: f.select(F.lit(name).alias("origin"), "score_id", "measure_idx", "h")
    return of(mine, "kept").unionAll(of(added, "added"))


@query("j26_anchor_samples", """, w AS (SELECT score_id, line, pos, x - 6 AS x1, x + 3 * length(text) AS x2, confidence >= 0.7 AS accepted, 1 + pos % 8 AS note_index FROM tokens)
SELECT w.score_id, w.pos, round((n.x - x1) / (x2 - x1), 6) AS relative_x FROM w JOIN notes n ON n.score_id = w.score_id AND n.measure_idx = w.line AND n.note_index = w.note_index WHERE accepted AND x2 > x1 AND (n.x - x1) / (x2 - x1) BETWEEN 0 AND 1""")
def j26(spark, sf_dir):
    """Where in its box an accepted word has its note, if inside."""
    w = core.tokens(spark, sf_dir).where("confidence >= 0.7").select("score_id", F.col("line").alias("measure_idx"), "pos", (F.col("x") - 6).alias("x1"), (F.col("x") + 3 * F.length("text")).alias("x2"), (1 + F.col("pos") % 8).alias("note_index")).where("x2 > x1")
    n = core.notes(spark, sf_dir).select("score_id", "measure_idx", "note_index", "x")
    at = (F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1"))
    return w.join(n, ["score_id", "measure_idx", "note_index"]).where(at.between(0, 1)).select("score_id", "pos", F.round(at, 6).alias("relative_x"))


@query("j27_inherited_attributes", CARRIED + " SELECT measure_key, divisions, coalesce(beats, 4) || '/' || coalesce(beat_type, 4) AS meter, fifths, count(*) OVER (PARTITION BY score_id, part_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING) AS given_until FROM carried")
def j27(spark, sf_dir):
    """A measure alone with every attribute that it inherits from those before it."""
    from ..operators.measures import carried

    w = Window.partitionBy("score_id", "part_id").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, 0)
    meter = F.concat(F.coalesce("beats", F.lit(4)), F.lit("/"), F.coalesce("beat_type", F.lit(4)))
    return carried(core.measures(spark, sf_dir)).select("measure_key", "divisions", meter.alias("meter"), "fifths", F.count("*").over(w).alias("given_until"))


@query("s2_json_artifacts", " SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing, 1 AS schema_version FROM events")
def s2(spark, sf_dir):
    """JSON artifacts with a schema that tolerates what is missing; the version is 1 where none is given."""
    e = core.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, missing string, schema_version int").alias("a"))
    return e.select("event_id", "a.k", F.col("a.missing").isNotNull().alias("has_missing"), F.coalesce("a.schema_version", F.lit(1)).alias("schema_version"))


@query("s9_geometry_version", ", g AS (SELECT run_id, page, CASE WHEN page % 4 = 3 THEN '5.9' ELSE '5.' || (10 + run_id % 3) || '.1' END AS version, length(text) % 9 AS heads FROM runs) SELECT run_id, count(*) AS sheets, CAST(sum(heads) AS BIGINT) AS heads FROM g WHERE regexp_matches(version, '^5\\.1[01]\\.') GROUP BY run_id")
def s9(spark, sf_dir):
    """Heads of the geometry files of a known version; others are left out."""
    version = F.when(F.col("page") % 4 == 3, "5.9").otherwise(F.concat(F.lit("5."), 10 + F.col("run_id") % 3, F.lit(".1")))
    g = core.runs(spark, sf_dir).withColumn("version", version).where(F.col("version").rlike(r"^5\.1[01]\."))
    return g.groupBy("run_id").agg(F.count("*").alias("sheets"), F.sum(F.length("text") % 9).cast("long").alias("heads"))


@query("s5_admission", """, f AS (SELECT page_id % 40 AS upload, page_id, length(html) AS size, ['pdf', 'png', 'txt', 'jpg'][1 + page_id % 4] AS extension FROM pages)
SELECT upload, count(*) AS members, count(*) BETWEEN 1 AND 50 AND bool_and(size <= 50000000 AND extension IN ('pdf', 'png', 'jpg', 'jpeg')) AS admitted FROM f GROUP BY upload""")
def s5(spark, sf_dir):
    """Uploads of 1 to 50 members of allowed kinds and at most 50 MB each."""
    from ..sources.files import admission

    k = F.col("page_id")
    name = F.concat(F.lit("page."), F.get(F.array(*[F.lit(x) for x in ("pdf", "png", "txt", "jpg")]), (k % 4).cast("int")))
    f = core.table(spark, sf_dir, "pages").select((k % 40).alias("source"), F.length("html").alias("length"), name.alias("name"))
    return admission(f).select(F.col("source").alias("upload"), F.col("pages").alias("members"), F.col("reason").isNull().alias("admitted"))


@query("s3_page_manifest", " SELECT page_id, CAST(regexp_extract(url, '(\\d+)[^\\d]*$', 1) AS VARCHAR) AS page_no, sha256(coalesce(html, '')) AS sha256, octet_length(encode(coalesce(html, ''))) AS size FROM pages")
def s3(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return core.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(\d+)[^\d]*$", 1).alias("page_no"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("size"))


@query("r9_backfill", HASHES + """, norm AS (SELECT score_id, measure_no, CASE WHEN score_id % 3 = 0 AND measure_no % 4 = 0 THEN sha256(xml_sha256) ELSE xml_sha256 END AS n FROM hashes),
s AS (SELECT score_id, bool_and(n = xml_sha256) AS untouched FROM norm JOIN hashes USING (score_id, measure_no) GROUP BY score_id)
SELECT score_id, measure_no, CASE WHEN untouched THEN 'update' ELSE 'keep' END AS current, CASE WHEN NOT untouched THEN 'XML_CHANGED' END AS violation FROM hashes JOIN s USING (score_id)""")
def r9(spark, sf_dir):
    """Scores whose current form is still what recognition made are rebuilt; in the others every measure goes to review."""
    h = hashes(spark, sf_dir)
    made = F.when((F.col("score_id") % 3 == 0) & (F.col("measure_no") % 4 == 0), F.sha2("xml_sha256", 256)).otherwise(F.col("xml_sha256"))
    same = F.bool_and(made == F.col("xml_sha256")).over(Window.partitionBy("score_id"))
    return h.select("score_id", "measure_no", F.when(same, "update").otherwise("keep").alias("current"), F.when(~same, "XML_CHANGED").alias("violation"))


VERIFIED = SUNG + CARRIED.replace("carried AS", "carried2 AS") + """, c AS (SELECT measure_key, count(*) AS n, sum(duration) AS total, bool_or(is_tuplet) AS tuplet FROM notes WHERE NOT is_rest AND NOT is_chord AND NOT is_grace GROUP BY ALL),
v AS (SELECT m.measure_key, c.n, coalesce(c.total, 0) * 1.0 / k.divisions AS beats, coalesce(k.beats * 4.0 / k.beat_type, 0) AS expected, m.measure_key % 5 AS extra, (c.total * k.divisions) % 2 = 0 AS exact, m.measure_key % 6 <> 0 OR c.tuplet AS marks_agree FROM measures m JOIN carried2 k USING (measure_key) LEFT JOIN c USING (measure_key))"""


@query("d11_verified_candidates", VERIFIED + " SELECT measure_key, coalesce(n > 0 AND extra <> 0 AND abs(beats - expected) < 0.001 AND exact AND marks_agree, false) AS verified FROM v")
def d11(spark, sf_dir):
    """A candidate counts if heads and every verse have as many notes, its length fits, marks have tuplets and durations convert exactly."""
    from ..operators.measures import carried

    c = core.notes(spark, sf_dir).where("not is_rest and not is_chord and not is_grace").groupBy("measure_key").agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.bool_or("is_tuplet").alias("tuplet"))
    k = carried(core.measures(spark, sf_dir)).join(c, "measure_key", "left")
    extra = F.when(F.col("measure_key") % 5 == 0, 1).otherwise(0)
    gates = [F.col("n") > 0, F.col("n") + extra == F.col("n"), F.abs(F.coalesce("total", F.lit(0)) / F.col("divisions") - F.coalesce(music.expected_beats(F.col("beats"), F.col("beat_type")), F.lit(0.0))) < 0.001, F.col("total") * F.col("divisions") % 2 == 0, (F.col("measure_key") % 6 != 0) | F.col("tuplet")]
    every = gates[0]
    for g in gates[1:]:
        every = every & g
    return k.select("measure_key", F.coalesce(every, F.lit(False)).alias("verified"))


TRIPLETS = """, h AS (SELECT measure_key, seq, row_number() OVER (PARTITION BY measure_key ORDER BY x, seq) AS i, duration = 4 AS hollow, x, measure_key % 40 + (seq * 7) % 24 AS y FROM notes WHERE NOT is_rest),
g AS (SELECT *, i <= 3 AS inside, count(*) FILTER (i <= 3) OVER (PARTITION BY measure_key) AS n_in, count(*) FILTER (i > 3) OVER (PARTITION BY measure_key) AS n_out, bool_or(i <= 3 AND hollow) OVER (PARTITION BY measure_key) AS hollow_in, bool_and(i <= 3 OR hollow) OVER (PARTITION BY measure_key) AS all_out FROM h)"""


@query("d10_image_proposals", TRIPLETS + ", p AS (SELECT *, 2 * n_out + 1 + measure_key % 3 - 2 * n_out AS remaining, 30 + CAST(round((measure_key % 40 + 24 - y) / 3.0) AS BIGINT) AS a FROM g WHERE n_in = 3 AND NOT hollow_in AND n_out > 0 AND all_out) SELECT measure_key, seq, substr('CDEFGAB', CAST(a % 7 + 1 AS INT), 1) || (a // 7) AS pitch, CASE WHEN inside THEN remaining / 3.0 ELSE 2.0 END AS quarters FROM p WHERE remaining IN (1, 2)")
def d10(spark, sf_dir):
    """Three filled heads under a bracket and hollow ones beside it: what is left of the measure goes to the three."""
    w = Window.partitionBy("measure_key")
    h = core.notes(spark, sf_dir).where("not is_rest").withColumn("i", F.row_number().over(w.orderBy("x", "seq")))
    hollow, inside = F.col("duration") == 4, F.col("i") <= 3
    g = h.withColumns({"n_in": F.sum(inside.cast("int")).over(w), "n_out": F.sum((~inside).cast("int")).over(w), "hollow_in": F.bool_or(inside & hollow).over(w), "all_out": F.bool_and(inside | hollow).over(w)}).where("n_in = 3 and not hollow_in and n_out > 0 and all_out")
    k = F.col("measure_key")
    g = g.withColumns({"remaining": 1 + k % 3, "a": music.diatonic(k % 40 + 24, k % 40 + (F.col("seq") * 7) % 24, F.lit(6.0))}).where("remaining in (1, 2)")
    return g.select("measure_key", "seq", music.diatonic_name(F.col("a")).alias("pitch"), F.when(inside, F.col("remaining") / 3.0).otherwise(2.0).alias("quarters"))


@query("d9_reconciled_tuplets", TRIPLETS + """, j AS (SELECT g.*, n.step, n.octave, n.duration, n.is_tuplet, 30 + CAST(round((g.measure_key % 40 + 24 - g.y) / 3.0) AS BIGINT) AS a FROM g JOIN notes n USING (measure_key, seq)),
q AS (SELECT measure_key, count(*) AS n, count(*) FILTER (inside) AS n_in, bool_or(inside AND (hollow OR duration <> 2)) AS bad, count(*) FILTER (step = substr('CDEFGAB', CAST(a % 7 + 1 AS INT), 1)) AS pitches, sum(CASE WHEN NOT inside THEN duration ELSE 0 END) AS outside FROM j GROUP BY ALL)
SELECT measure_key, n, pitches, n_in = 3 AND NOT bad AND measure_key % 3 + 2 - outside = 2 AS agrees FROM q""")
def d9(spark, sf_dir):
    """Whether exactly three filled quarters lie under the bracket and two beats remain for them, with the pitches that the image confirms."""
    w = Window.partitionBy("measure_key").orderBy("x", "seq")
    k, hollow, inside = F.col("measure_key"), F.col("duration") == 4, F.col("i") <= 3
    h = core.notes(spark, sf_dir).where("not is_rest").withColumn("i", F.row_number().over(w))
    a = music.diatonic(k % 40 + 24, k % 40 + (F.col("seq") * 7) % 24, F.lit(6.0))
    q = h.groupBy("measure_key").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in"), F.bool_or(inside & (hollow | (F.col("duration") != 2))).alias("bad"), F.count_if(F.col("step") == F.left(music.diatonic_name(a), F.lit(1))).alias("pitches"), F.sum(F.when(~inside, F.col("duration")).otherwise(0)).alias("outside"))
    return q.select("measure_key", "n", "pitches", ((F.col("n_in") == 3) & ~F.col("bad") & (k % 3 + 2 - F.col("outside") == 2)).alias("agrees"))
