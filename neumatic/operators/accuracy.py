"""Accuracy against verified truth: note and lyric error rates, annotation overlaps, gates. What has no truth is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequences

# What has to be reached before repairs may be automatic.
PRECISION, COVERAGE, LOAD, SOURCES, SAMPLES = 0.99, 0.95, 0.20, 20, (30, 50)


def note_token() -> Column:
    """voice, pitch or REST, duration, and whether the note begins or joins a chord, of a note that is no grace note."""
    pitch = F.when(F.col("is_rest"), "REST").otherwise(F.concat_ws(":", "step", "alter_by", "octave"))
    return F.concat_ws("|", "voice", pitch, "duration", F.when(F.col("is_chord"), "chord").otherwise("onset"))


def ordered(order: str, value: Column) -> Column:
    """Aggregate: values as an array in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"])


def accuracy(edits: Column, expected: Column, actual: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - edits / F.greatest(expected, actual, F.lit(1))), 6)


def error_rate(edits: Column, expected: Column) -> Column:
    return F.round(edits / F.greatest(expected, F.lit(1)), 6)


def compared(truth: DataFrame, predicted: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, expected and actual arrays of both sides in order, and their edit distance; a side that is missing is empty."""
    a = truth.groupBy(*keys).agg(ordered(order, F.col(value)).alias("expected"))
    b = predicted.groupBy(*keys).agg(ordered(order, F.col(value)).alias("actual"))
    none = F.array().cast("array<string>")
    j = a.join(b, keys, "full").select(*keys, F.coalesce("expected", none).alias("expected"), F.coalesce("actual", none).alias("actual"))
    return j.withColumn("edits", sequences.edit_distance("expected", "actual"))


def compared_within(rows: DataFrame, keys: list[str], order: str, value: Column, kept: Column, read: Column) -> DataFrame:
    """As compared(), of rows that hold both sides: `value` in truth, `read` where it was `kept`. Rows are grouped once and nothing is joined."""
    seen = F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct(order, read.alias("v"))))), lambda x: x["v"])
    return rows.groupBy(*keys).agg(ordered(order, value).alias("expected"), seen.alias("actual")).withColumn("edits", sequences.edit_distance("expected", "actual"))


def lyric_rates(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Edits, lengths and error rates of words and of characters per group; words come as (keys, pos, text)."""
    return rates(compared(truth.withColumn("text", F.lower("text")), predicted.withColumn("text", F.lower("text")), keys, "pos", "text"), keys)


def rates(c: DataFrame, keys: list[str]) -> DataFrame:
    """lyric_rates() of groups as compared() gives them."""
    full, read = F.array_join("expected", " "), F.array_join("actual", " ")
    c = c.select(*keys, F.size("expected").alias("words"), F.size("actual").alias("words_read"), F.col("edits").alias("word_edits"), F.length(full).alias("chars"), sequences.letter_distance(full, read).alias("char_edits"))
    return c.withColumns({"word_error_rate": error_rate(F.col("word_edits"), F.col("words")), "character_error_rate": error_rate(F.col("char_edits"), F.col("chars"))})


def gate(measures: DataFrame, labels: DataFrame, seconds: DataFrame, sources: DataFrame, group: list[str]) -> DataFrame:
    """Precision of ACCEPT, coverage of errors, review load and whether targets are met, per group.

    measures: group, id, decision, source_sha256; labels: group, id, correct,
    verified, source_sha256 — they count only if verified and of the same
    source; seconds: group, seconds; sources: group, verified_sources.
    """
    mine = labels.where("verified").select(*group, "id", "correct", F.col("source_sha256").alias("truth_sha256"))
    j = measures.join(mine, [*group, "id"], "left").withColumn("correct", F.when(F.col("source_sha256").isNull() | (F.col("source_sha256") == F.col("truth_sha256")), F.col("correct")))
    accept, known = F.col("decision") == "accept", F.col("correct").isNotNull()
    share = lambda what, of: F.count_if(what & of) / F.nullif(F.count_if(of), F.lit(0))
    g = j.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(known).alias("labelled"), share(F.col("correct"), accept & known).alias("accept_precision"),
        share(~accept, known & ~F.col("correct")).alias("error_coverage"), share(~accept, F.lit(True)).alias("review_load"))
    g = g.join(seconds, group, "left").join(sources, group, "left")
    met = (F.col("labelled") == F.col("total")) & (F.col("accept_precision") >= PRECISION) & (F.col("error_coverage") >= COVERAGE) & (F.col("review_load") <= LOAD)
    return g.withColumns({"complete": F.col("labelled") == F.col("total"), "targets_met": F.coalesce(met, F.lit(False))}).withColumn("auto_repair", F.col("targets_met") & (F.coalesce("verified_sources", F.lit(0)) >= SOURCES))
