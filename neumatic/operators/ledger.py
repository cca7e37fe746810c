"""The measure ledger: evidence per measure and staff, rules, decision, review queue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from . import measures as m

SEVERITIES = ["error", "warning", "info"]


@dataclass(frozen=True)
class Rule:
    """A named check: when it fires, how severe it is, and its message, all as columns of the evidence row."""

    name: str
    when: Column
    severity: Column
    message: Column


_RULES: dict[str, Rule] = {}


def register_rule(name: str, *, when: Column, severity: Column, message: Column) -> None:
    """Add or replace a rule; rules are evaluated in order of registration, after the standard ones."""
    _RULES[name] = Rule(name, when, severity, message)


def unregister_rule(name: str) -> None:
    """Take a rule out again; one that is not there is ignored."""
    _RULES.pop(name, None)


def standard_rules() -> list[Rule]:
    """The rules over evidence(): ten on notes, image, lyrics and chords, and the evidence and OCR checks."""
    c, values = F.col, F.map_values("lyrics")
    some = F.size("lyrics") > 0
    over = F.exists(values, lambda n: (n > c("sung_notes")) | ((c("sung_notes") - n > c("melisma")) & (c("section_type") != "mixed")))
    out_of_range = F.exists("midi", lambda p: (p < 57) | (p > 81))
    text = lambda s: F.lit(s)
    error, warning = F.lit("error"), F.lit("warning")
    return [
        Rule("C1", c("lyrics_complete") & over, F.when(c("slurs_known"), error).otherwise(warning), text("verses and sung notes differ")),
        Rule("C2", c("image_available") & ~c("heads").eqNullSafe(c("notes")), F.when(c("image_reliable"), error).otherwise(warning), F.concat(text("image heads "), F.coalesce("heads", F.lit(0)), text(", notes "), "notes")),
        Rule("C3", (F.coalesce("expected", F.lit(0.0)) != 0) & (F.abs(c("beats") - c("expected")) > 0.001) & ~c("pickup"), error, text("length differs from the time signature")),
        Rule("C4", ((c("tuplet_marks") > 0) & (c("tuplets") == 0)) | ((c("tuplets") > 0) & (c("tuplet_marks") == 0) & c("image_available")), F.when(c("tuplet_marks") > 0, error).otherwise(warning), text("tuplet marks and tuplets differ")),
        Rule("C5", c("lyrics_complete") & (c("section_type") != "mixed") & some & (F.array_max(values) - F.array_min(values) > c("melisma")), warning, text("verses differ in syllables")),
        Rule("C6", c("unexplained_ink") > 0, warning, text("ink without an explanation")),
        Rule("C7", c("continuity_conflict"), warning, text("lyrics do not continue")),
        Rule("C8", c("clef_conflict") | c("key_conflict"), error, text("clef or key without support")),
        Rule("C9", some & (out_of_range | c("leap")), F.lit("info"), text("range or leap")),
        Rule("C10", c("out_of_key") > 0, warning, text("chords outside the key")),
        Rule("EVIDENCE", ~c("image_available") | ~c("sources_agree"), warning, text("too few sources agree")),
        Rule("OCR", c("ocr_review") > 0, warning, text("words to check")),
        Rule("XML_CHANGED", c("xml_changed"), warning, text("the score differs from what was recognised")),
        Rule("METADATA", c("metadata_open"), warning, text("title, key or meter to check")),
    ]


def staff_rows(events: DataFrame) -> DataFrame:
    """One row per measure and staff from one pass over the events, which carry their measure's columns.

    events: those of plans.core.score_events with divisions, beats, beat_type
    and fifths (see carried()); a measure without events comes as a row
    without kind. All windows and groups lie within a measure, so events that
    are partitioned by measure_key are not moved again; only the finished rows
    are, once, to look at first and last measures of a part.
    """
    c, measure = F.col, Window.partitionBy("measure_key")
    staff = Window.partitionBy("measure_key", "staff").orderBy("seq")
    whole = staff.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_note = F.coalesce(c("kind") == "note", F.lit(False))
    pitched = is_note & ~c("is_rest") & ~c("is_grace")
    e = events.withColumns({"step_by": m.step_of(), "is_note": is_note, "pitched": F.coalesce(pitched, F.lit(False))})
    e = e.withColumn("cursor", F.sum("step_by").over(measure.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumns({
        "length": F.greatest(F.max(F.when(c("kind") != "backup", c("cursor"))).over(measure), F.lit(0)),
        "outside": F.sum(F.when((c("kind") == "harmony") & ~music.in_key(c("step"), c("alter_by"), c("fifths")), 1).otherwise(0)).over(measure),
        "primary": F.first(F.when(c("pitched"), c("voice")), True).over(whole)})
    e = e.withColumn("sung", F.coalesce(c("pitched") & (c("voice") == c("primary")) & ~c("is_chord") & ~c("tie_stop"), F.lit(False)))
    # slurs and leaps look at the sung notes alone
    line = Window.partitionBy("measure_key", "staff", "sung").orderBy("seq")
    sign = F.when(c("slur_start"), 1).when(c("slur_stop"), 0)
    e = e.withColumn("midi", F.when(c("sung"), music.midi_pitch(c("step"), c("octave"), c("alter_by"))))
    e = e.withColumns({"slurred": F.coalesce(F.last(sign, True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "next1": F.lead("midi", 1).over(line), "next2": F.lead("midi", 2).over(line)})
    leap = c("sung") & F.coalesce((F.abs(c("next1") - c("midi")) > 12) & (F.abs(c("next2") - c("midi")) <= 2), F.lit(False))
    attributes = ["score_id", "part_id", "measure_key", "measure_idx", "divisions", "beats", "beat_type", "fifths", "length", "outside"]
    rows = e.groupBy(*attributes, "staff").agg(
        F.count_if("is_note").alias("all_notes"), F.count_if("pitched").alias("notes"), F.count_if(c("is_note") & c("is_tuplet")).alias("tuplets"), F.count_if("sung").alias("sung_notes"),
        F.sum(F.when(c("sung"), c("slurred")).otherwise(0)).alias("melisma"), F.array_sort(F.collect_list(F.when(c("sung"), F.struct("seq", "midi")))).alias("line"), F.bool_or(leap).alias("leap"))
    part = Window.partitionBy("score_id", "part_id").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"actual": c("length") / c("divisions"), "expected": music.expected_beats(c("beats"), c("beat_type"))})
    first, last, want = F.first("actual").over(part), F.last("actual").over(part), F.first("expected").over(part)
    pair = F.coalesce((first < want) & (F.abs(first + last - want) < 0.001), F.lit(False))
    at_end = (c("measure_idx") == F.min("measure_idx").over(part)) | (c("measure_idx") == F.max("measure_idx").over(part))
    return rows.withColumn("pickup", pair & at_end).where("all_notes > 0")


FLAGS = ("slurs_known", "continuity_conflict", "clef_conflict", "key_conflict", "xml_changed", "metadata_open")


def evidence(events: DataFrame, tokens: DataFrame, image: Callable[[DataFrame], DataFrame], flags: dict[str, Column] | None = None) -> DataFrame:
    """One row per measure and staff with everything the rules look at.

    events: see staff_rows(). tokens: score_id, measure_idx, staff, verse,
    has_letter, needs_review, section_type. image adds heads, available,
    reliable, tuplet_marks and ink to the rows (by a join, or as columns).
    flags: columns over these rows for slurs_known (true by default),
    continuity_conflict, clef_conflict, key_conflict, xml_changed and
    metadata_open (false by default).
    """
    key = ["score_id", "measure_idx", "staff"]
    # counted by section first: whole numbers and keys only, so that the many words are hashed and not sorted
    verses = tokens.groupBy(*key, "verse", "section_type").agg(F.count_if("has_letter").cast("int").alias("n"), F.count_if("needs_review").alias("review"))
    parts = F.filter(F.col("parts"), lambda p: p["n"] > 0)
    total = lambda v: F.aggregate(parts, F.lit(0), lambda a, p: a + F.when(p["verse"] == v, p["n"]).otherwise(0))
    lyrics = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["verse"]))), lambda v: F.struct(v, total(v))))
    words = verses.groupBy(*key).agg(
        F.collect_list(F.struct(F.col("verse").cast("string").alias("verse"), "n")).alias("parts"), F.sum("review").alias("ocr_review"),
        F.when(F.min("section_type") == F.max("section_type"), F.min("section_type")).otherwise("mixed").alias("section_type"))
    words = words.select(*key, lyrics.alias("lyrics"), "ocr_review", "section_type")
    e = image(staff_rows(events)).join(words, key, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    given = flags or {}
    return e.select(
        "score_id", "measure_key", "measure_idx", "staff", "notes", "tuplets", "sung_notes", "melisma", F.col("actual").alias("beats"), "expected", "pickup", "fifths",
        F.transform("line", lambda x: x["midi"]).alias("midi"), "leap", F.col("outside").alias("out_of_key"),
        F.coalesce("lyrics", none).alias("lyrics"), F.col("ocr_review").isNotNull().alias("lyrics_complete"), zero("ocr_review").alias("ocr_review"), F.coalesce("section_type", F.lit("mixed")).alias("section_type"),
        "heads", F.coalesce("available", F.lit(False)).alias("image_available"), F.coalesce("reliable", F.lit(False)).alias("image_reliable"), zero("tuplet_marks").alias("tuplet_marks"), zero("ink").alias("unexplained_ink"),
        F.coalesce((F.col("heads") == F.col("notes")) & F.col("available"), F.lit(False)).alias("sources_agree"),
        *[given.get(f, F.lit(f == "slurs_known")).alias(f) for f in FLAGS])


def decided(evidence: DataFrame) -> DataFrame:
    """evidence with `violations` and `decision`: review if any violation is more than information."""
    rules = [*standard_rules(), *_RULES.values()]
    found = F.filter(F.array(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.severity.alias("severity"), r.message.alias("message"))) for r in rules]), lambda v: v.isNotNull())
    out = evidence.withColumn("violations", found)
    return out.withColumn("decision", F.when(F.exists("violations", lambda v: v["severity"] != "info"), "review").otherwise("accept"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def queue(ledger: DataFrame) -> DataFrame:
    """Measures to review of each score in order: metadata cards, then worst severity, first violated rule, measure number."""
    worst = F.array_min(F.transform("violations", lambda v: severity_rank(v["severity"])))
    q = ledger.where("decision = 'review'").withColumns({"worst": worst, "first_rule": F.col("violations")[0]["rule"]})
    card = F.when(F.exists("violations", lambda v: v["rule"] == "METADATA"), 0).otherwise(1)
    order = Window.partitionBy("score_id").orderBy(card, "worst", "first_rule", "measure_idx", "staff", "measure_key")
    return q.withColumn("place", F.row_number().over(order).cast("long"))


def rule_totals(ledger: DataFrame) -> DataFrame:
    """How often each rule fires, by severity."""
    v = ledger.select(F.explode("violations").alias("v"))
    return v.groupBy(F.col("v.rule").alias("rule"), F.col("v.severity").alias("severity")).agg(F.count("*").alias("n"))


def review_load(ledger: DataFrame) -> DataFrame:
    """Measures, those to review, and their share, per score."""
    return ledger.groupBy("score_id").agg(F.count("*").alias("n_measures"), F.count_if(F.col("decision") == "review").alias("to_review"), F.avg((F.col("decision") == "review").cast("double")).alias("load"))
