"""Measures and notes: carry-forward, lengths, layout counters, ties, slurs, onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music, rational

PART = ["score_id", "part_id"]


def carried(measures: DataFrame) -> DataFrame:
    """Divisions, time and key of each measure, inherited from the last measure of the part that gives them."""
    w = Window.partitionBy(*PART).orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return measures.withColumns({"divisions": F.coalesce(last("divisions_given"), F.lit(1)), "beats": last("beats"), "beat_type": last("beat_type"), "fifths": F.coalesce(last("fifths_given"), F.lit(0))})


def step_of(event: DataFrame | None = None) -> Column:
    """How far an event moves the cursor: chord and grace notes and harmonies not at all."""
    still = F.col("is_chord") | F.col("is_grace")
    return F.when(F.col("kind") == "note", F.when(still, F.lit(0)).otherwise(F.col("duration"))).when(F.col("kind") == "forward", F.col("duration")).when(F.col("kind") == "backup", -F.col("duration")).otherwise(0)


def with_cursor(events: DataFrame) -> DataFrame:
    """Cursor before and after every event of a measure, in document order."""
    w = Window.partitionBy("measure_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    moved = events.withColumn("step_by", step_of()).withColumn("cursor", F.sum("step_by").over(w))
    return moved.withColumn("before", F.col("cursor") - F.col("step_by"))


def lengths(events: DataFrame) -> DataFrame:
    """measure_key, length: the furthest cursor of a measure, in divisions."""
    return with_cursor(events).groupBy("measure_key").agg(F.greatest(F.max(F.when(F.col("kind") != "backup", F.col("cursor"))), F.lit(0)).alias("length"))


def rhythm(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Length and expected length of every measure in beats; pickup marks a short first measure that the last completes."""
    m = carried(measures).join(lengths(events), "measure_key", "left")
    m = m.withColumns({"actual": F.coalesce("length", F.lit(0)) / F.col("divisions"), "expected": music.expected_beats(F.col("beats"), F.col("beat_type"))})
    w = Window.partitionBy(*PART).orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, want = F.first("actual").over(w), F.last("actual").over(w), F.first("expected").over(w)
    pair = F.coalesce((first < want) & (F.abs(first + last - want) < 0.001), F.lit(False))
    at_end = (F.col("measure_idx") == F.min("measure_idx").over(w)) | (F.col("measure_idx") == F.max("measure_idx").over(w))
    return m.withColumn("pickup", pair & at_end)


def wrong_length(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Measures whose length is not what the time signature asks for."""
    return rhythm(measures, events).where((F.col("expected") > 0) & (F.abs(F.col("actual") - F.col("expected")) > 0.001) & ~F.col("pickup"))


def voice_lengths(events: DataFrame) -> DataFrame:
    """Sum of durations of each voice in a measure."""
    return events.where("kind = 'note' and not is_chord and not is_grace").groupBy("score_id", "measure_key", "measure_idx", "voice").agg(F.sum("duration").alias("total"))


def layout(measures: DataFrame, default_width: float = 100.0) -> DataFrame:
    """Page and system of each measure (from 1) and its offset within the system."""
    w = Window.partitionBy(*PART).orderBy("measure_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    breaks = (F.col("new_page") | F.col("new_system")) & ~first
    m = measures.withColumns({"page": 1 + F.sum((F.col("new_page") & ~first).cast("long")).over(upto), "system": 1 + F.sum(breaks.cast("long")).over(upto), "w": F.coalesce(F.col("width").cast("double"), F.lit(default_width))})
    before = Window.partitionBy(*PART, "system").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("offset", F.coalesce(F.sum("w").over(before), F.lit(0.0))).drop("w")


def renumbered(measures: DataFrame) -> DataFrame:
    """Numbers through all pages of a part: page 1 keeps its own, later pages go on from the last."""
    paged = layout(measures)
    w = Window.partitionBy(*PART).orderBy("measure_idx")
    return paged.withColumn("number", F.row_number().over(w).cast("long")).withColumn("local_number", F.row_number().over(Window.partitionBy(*PART, "page").orderBy("measure_idx")).cast("long"))


def merged(entries: DataFrame, *, keys: list[str] = ("score_id",)) -> DataFrame:
    """entries with `number` and `expected`: one numbering of a part through all pages.

    entries: keys, part_id, page, nth (order within the page), local_number,
    own_number, expected_given. On page 1 a part keeps its own numbers (a pickup
    stays 0); on later pages each local number that is new goes on from the
    last number the part has had, from 1 for a part that joins late. An entry
    without expected beats has those of the part's entry before it, also from
    the page before.
    """
    part = [*keys, "part_id"]
    order = Window.partitionBy(*part).orderBy("page", "nth")
    fresh = F.row_number().over(Window.partitionBy(*part, "page", "local_number").orderBy("nth")) == 1
    e = entries.withColumn("_fresh", fresh)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.coalesce(F.last(F.when((F.col("page") == 1) & F.col("_fresh"), F.col("own_number")), ignorenulls=True).over(every), F.lit(0))
    later = F.sum(((F.col("page") > 1) & F.col("_fresh")).cast("long")).over(upto)
    e = e.withColumns({"_number": F.when(F.col("page") == 1, F.col("own_number")).otherwise(base + later), "expected": F.last("expected_given", ignorenulls=True).over(upto)})
    same = Window.partitionBy(*part, "page", "local_number").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.withColumn("number", F.first("_number").over(same)).drop("_fresh", "_number")


def staff_rows(notes: DataFrame, measures: DataFrame, *, keys: list[str] = ("score_id",), default_width: float = 100.0) -> DataFrame:
    """notes with page, system, row and x on their page: the staff rows that text is matched with.

    notes: keys, part_id, part_idx, measure_idx, staff, local_x; measures: keys,
    part_id, measure_idx, new_page, new_system, width. Systems of a page count
    from 0; a row is the system times all staves of the score, and the staves
    of the parts before, and the staff. Measures before stand to the left in
    their system, with `default_width` where no width is given.
    """
    part = [*keys, "part_id"]
    order = Window.partitionBy(*part).orderBy("measure_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    m = measures.withColumn("page", 1 + F.sum(F.col("new_page").cast("long")).over(upto))
    page = Window.partitionBy(*part, "page").orderBy("measure_idx")
    m = m.withColumn("system", F.sum((F.col("new_system") & ~F.col("new_page")).cast("long")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    system = Window.partitionBy(*part, "page", "system").orderBy("measure_idx").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("left", F.coalesce(F.sum(F.coalesce(F.col("width").cast("double"), F.lit(default_width))).over(system), F.lit(0.0)))
    staves = notes.groupBy(*part, "part_idx").agg(F.max("staff").alias("staves"))
    whole = Window.partitionBy(*keys)
    staves = staves.select(*part, F.coalesce(F.sum("staves").over(whole.orderBy("part_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("staves").over(whole).alias("all"))
    n = notes.join(m.select(*part, "measure_idx", "page", "system", "left"), [*part, "measure_idx"]).join(staves, part)
    return n.withColumns({"row": F.col("system") * F.col("all") + F.col("first") + F.col("staff") - 1, "x": F.col("left") + F.col("local_x")}).drop("left", "first", "all", "local_x")


def sung(notes: DataFrame) -> DataFrame:
    """Notes of the primary voice that take lyrics: no rest, chord, grace or tie stop."""
    pitched = notes.where("not is_rest and not is_grace")
    first = Window.partitionBy("measure_key", "staff").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pitched.withColumn("primary", F.first("voice").over(first)).where("voice = primary and not is_chord and not tie_stop")


def eligible() -> Column:
    """A note that can take a lyric: not rest, chord or grace, and not a pure tie stop."""
    return ~F.col("is_rest") & ~F.col("is_chord") & ~F.col("is_grace") & ~(F.col("tie_stop") & ~F.col("tie_start"))


def in_slur(notes: DataFrame, key: str = "measure_key") -> DataFrame:
    """Whether a slur is open before each note: the last slur sign before it is a start."""
    w = Window.partitionBy(key, "staff").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("slur_start"), 1).when(F.col("slur_stop"), 0)
    return notes.withColumn("slurred", F.coalesce(F.last(sign, ignorenulls=True).over(w), F.lit(0)))


def note_counts(notes: DataFrame) -> DataFrame:
    """Per measure and staff: notes, sung notes, melisma, tuplets and out-of-range pitches."""
    all_ = notes.groupBy("score_id", "measure_key", "measure_idx", "staff").agg(F.count_if(~F.col("is_rest") & ~F.col("is_grace")).alias("notes"), F.count_if("is_tuplet").alias("tuplets"))
    s = in_slur(sung(notes)).withColumn("midi", music.midi_pitch(F.col("step"), F.col("octave"), F.col("alter_by")))
    s = s.groupBy("measure_key", "staff").agg(F.count("*").alias("sung_notes"), F.sum("slurred").alias("melisma"), F.array_sort(F.collect_list(F.struct("seq", "midi"))).alias("line"))
    return all_.join(s, ["measure_key", "staff"], "left").withColumns({"sung_notes": F.coalesce("sung_notes", F.lit(0)), "melisma": F.coalesce("melisma", F.lit(0))})


def leaps(notes: DataFrame) -> DataFrame:
    """Sung notes out of range, or before a leap of more than an octave that returns within two semitones."""
    w = Window.partitionBy("measure_key", "staff").orderBy("seq")
    s = sung(notes).withColumn("midi", music.midi_pitch(F.col("step"), F.col("octave"), F.col("alter_by")))
    s = s.withColumns({"next1": F.lead("midi", 1).over(w), "next2": F.lead("midi", 2).over(w)})
    leap = F.coalesce((F.abs(F.col("next1") - F.col("midi")) > 12) & (F.abs(F.col("next2") - F.col("midi")) <= 2), F.lit(False))
    return s.withColumns({"out_of_range": (F.col("midi") < 57) | (F.col("midi") > 81), "leap": leap}).where("out_of_range or leap")


def onsets(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Onset of notes and harmonies as a reduced fraction of a beat; chord notes share the onset before them, a harmony adds its offset_ticks (if events have them)."""
    moved = with_cursor(events).join(carried(measures).select("measure_key", "divisions"), "measure_key")
    w = Window.partitionBy("measure_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.when((F.col("kind") == "note") & ~F.col("is_chord") & ~F.col("is_grace"), F.col("before"))
    on = F.when((F.col("kind") == "note") & F.col("is_chord"), F.coalesce(F.last(lead, ignorenulls=True).over(w), F.lit(0))).otherwise(F.col("before"))
    offset = F.coalesce(F.when(F.col("kind") == "harmony", F.col("offset_ticks")), F.lit(0)) if "offset_ticks" in events.columns else F.lit(0)
    moved = moved.withColumns({"ticks": on, "offset": offset})
    placed = moved.where("kind in ('note', 'harmony')").withColumn("at", rational.fraction(F.col("ticks") + F.col("offset"), F.col("divisions")))
    return placed.select("measure_key", "seq", "kind", "at.num", "at.den")


def repaired(measures: DataFrame, events: DataFrame) -> DataFrame:
    """Proposed padding or trimming of the last note so that a measure has its expected length (a proposal, never applied)."""
    r = rhythm(measures, events).where("expected > 0")
    gap = F.col("expected") - F.col("actual")
    return r.where(F.abs(gap) > 0.001).select("measure_key", "score_id", "measure_idx", F.when(gap > 0, "pad").otherwise("trim").alias("action"), music.quantised(F.abs(gap)).alias("amount"))
