"""Roles of text lines by their band, and how many of them a reading has right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import music
from . import sequences, syllables

# Fixed patterns and shares: whole lines between or below staffs, beginnings and whole lines above them; least share of chords, most of other words.
MARKERS = {"section_marker": r"^(?:Đ\.?K\.?|Điệp khúc|Coda|Kết|Fine)\s*:?$", "verse_marker": r"^(?:\d+[.)]|Lời\s+\d+)\s*$"}
ABOVE = {"tempo": r"^(?:Allegro|Andante|Moderato|Adagio|Tempo|Chậm|Nhanh|Vừa phải)(?![\p{L}\p{N}_])", "key_info": r"^(?:Giọng|Key)(?![\p{L}\p{N}_])", "direction": r"^(?:D\.[CS]\.?.*|Fine|Coda)$"}
CHORDS, OTHERS = 0.7, 0.3


def line_roles(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with text, chord_ratio, syllable_ratio, role and needs_review (no role found).

    words: keys (of a line), pos, text, band. Between and below staffs a line
    is sung unless it is a marker; above them a line of chords, a mark, or
    unknown, and a symbol that is both chord and word counts as a chord.
    Elsewhere lines are unknown.
    """
    w = syllables.is_valid(words.withColumn("low", syllables.normalised(F.col("text"))), "low", "valid").withColumn("chord", music.is_chord(F.col("text")))
    share = lambda c: F.count_if(c) / F.count("*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    l = w.groupBy(*keys).agg(joined.alias("text"), F.any_value("band").alias("band"), share(F.col("chord")).alias("chord_ratio"), share(F.col("valid")).alias("syllable_ratio"), share(F.col("valid") & ~F.col("chord")).alias("others"))
    below = F
    for role, p in MARKERS.items():
        below = below.when(F.col("text").rlike("(?iu)" + p), role)
    above = F.when((F.col("chord_ratio") >= CHORDS) & (F.col("others") < OTHERS), "chord")
    for role, p in ABOVE.items():
        above = above.when(F.col("text").rlike("(?iu)" + p), role)
    role = F.when(F.col("band").isin("below", "between"), below.otherwise("lyric")).when(F.col("band") == "above", above.otherwise("unknown")).otherwise("unknown")
    return l.select(*keys, "text", "chord_ratio", "syllable_ratio", role.alias("role")).withColumn("needs_review", F.col("role") == "unknown")


def role_accuracy(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: lines of truth, and the share whose paired line (sequences.greedy_pairs) has the same role.

    Both: keys, box_id, x1, y1, x2, y2, role.
    """
    pairs = sequences.greedy_pairs(truth.drop("role"), predicted.drop("role"), keys)
    other = predicted.select(*keys, F.col("box_id").cast("long").alias("predicted_id"), F.col("role").alias("found"))
    own = truth.select(*keys, F.col("box_id").cast("long").alias("truth_id"), "role")
    j = own.join(pairs.select(*keys, "truth_id", "predicted_id"), [*keys, "truth_id"], "left").join(other, [*keys, "predicted_id"], "left")
    return j.groupBy(*keys).agg(F.count("*").alias("lines"), F.round(F.count_if(F.col("role") == F.col("found")) / F.count("*"), 6).alias("text_role_accuracy"))
