"""Numbering that spreads over many tasks, and exports made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import computed


def numbered(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """rows with `place`, their number within the group, without bringing a group into one task.

    Rows are sorted into ranges of (group, order) whose bounds are quantiles, so
    a group of any size, or with any common beginning of its names, fills as
    many tasks as it needs. Each range counts its rows, and a group's rows in a
    range are numbered from where its ranges before end. The sorted rows are
    checkpointed, as numbering reads them twice.
    """
    by = [*(F.col(g) for g in group), *order]
    r = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    r = computed(r).withColumn("_range", F.shiftright("_id", 33))
    sizes = r.groupBy(*group, "_range").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("_shift"))
    same = F.col("r._range") == F.col("s._range")
    for g in group:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    joined = r.alias("r").join(starts.alias("s"), same)
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r._id") + F.col("s._shift")).alias("place"))


def padded(text: Column, width: int, fill: str, left: bool) -> Column:
    """The text filled up to `width`; a longer one stays whole."""
    room = F.greatest(F.lit(width), F.length(text))
    return (F.lpad if left else F.rpad)(text, room, F.lit(fill))


def contents(scores: DataFrame) -> DataFrame:
    """book, place and line of a table of contents: number, title and page in columns, then the total."""
    n = numbered(scores, ["book"], ["title", "score_id"])
    line = F.concat(padded(F.col("place").cast("string"), 4, " ", True), F.lit("  "), padded(F.col("title"), 30, ".", False), padded(F.col("score_id").cast("string"), 8, " ", True))
    total = scores.groupBy("book").agg(F.count("*").alias("n"))
    last = total.select("book", (F.col("n") + 1).alias("place"), F.concat(F.lit("TOTAL "), padded(F.col("n").cast("string"), 8, " ", True)).alias("line"))
    return n.select("book", "place", line.alias("line")).unionAll(last)
