"""Page geometry as tables: staff lines, systems, bands, boxes against staves and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in staff spaces or shares: gaps, margins and sizes of the layout rules.
SYSTEM_GAP, BAND, REGION, FOOTER = 7.0, 0.5, 2.0, 0.92


def systems(staves: DataFrame, keys: list[str]) -> DataFrame:
    """staves (top, bottom, interline, linked, measure_key) with `system`: a new one begins after a gap of more than 7 of the wider interline that no bar line crosses."""
    w = Window.partitionBy(*keys).orderBy("top", "measure_key")
    wide = F.greatest("interline", F.lag("interline").over(w), F.lit(1.0))
    new = F.coalesce((F.col("top") - F.lag("bottom").over(w) > SYSTEM_GAP * wide) & ~F.col("linked"), F.lit(False))
    return staves.withColumn("new", new.cast("long")).withColumn("system", 1 + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def bands(staves: DataFrame, keys: list[str], height: Column) -> DataFrame:
    """keys, system, kind (above, between, below), measure_key and y1, y2 of the text bands around staves (with `system`)."""
    w = Window.partitionBy(*keys).orderBy("top", "measure_key")
    own = Window.partitionBy(*keys, "system").orderBy("top", "measure_key")
    s = staves.withColumns({"above_bottom": F.lag("bottom").over(w), "next_top": F.lead("top").over(w), "first": F.row_number().over(own) == 1, "last": F.lead("top").over(own).isNull(), "inter": F.median("interline").over(Window.partitionBy(*keys))})
    half = BAND * F.col("inter")
    # between systems, text belongs to either side of the middle of the gap
    middle = lambda low, high: F.floor((low + half + (high - half)) / 2)
    up = F.when(F.col("above_bottom").isNull(), 0).otherwise(middle(F.col("above_bottom"), F.col("top")))
    down = F.when(F.col("next_top").isNull(), height).otherwise(middle(F.col("bottom"), F.col("next_top")))
    low, high = F.floor(F.col("top") - half), F.floor(F.col("bottom") + half)
    kinds = F.array(
        F.when(F.col("first"), F.struct(F.lit("above").alias("kind"), up.cast("double").alias("y1"), F.greatest(up.cast("double"), low.cast("double")).alias("y2"))),
        F.when(~F.col("last"), F.struct(F.lit("between").alias("kind"), high.cast("double").alias("y1"), F.floor(F.col("next_top") - half).cast("double").alias("y2"))),
        F.when(F.col("last"), F.struct(F.lit("below").alias("kind"), high.cast("double").alias("y1"), down.cast("double").alias("y2"))))
    return s.select(*keys, "system", "measure_key", F.explode(F.array_compact(kinds)).alias("b")).select(*keys, "system", "measure_key", "b.*")


def five_lines(lines: Column) -> Column:
    """Staff lines made five: a fourth is added where the widest gap says, more than five are spread evenly."""
    s = F.array_sort(lines)
    first, last, gap = F.get(s, F.lit(0)), F.element_at(s, -1), (F.element_at(s, -1) - F.get(s, F.lit(0))) / 3
    four = F.when(F.get(s, F.lit(1)) - first > 1.5 * gap, F.concat(F.array(first - gap), s)).otherwise(F.concat(s, F.array(last + gap)))
    even = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: first + i * (last - first) / 4)
    return F.when(F.size(s) == 4, four).when(F.size(s) > 5, even).otherwise(s)


def page_lines(lines: Column, y: Column) -> Column:
    """Lines of a crop at y in page coordinates; null unless there are five."""
    return F.when(F.size(lines) == 5, F.transform(F.array_sort(lines), lambda v: v + y))


def gaps(lines: Column) -> Column:
    return F.zip_with(F.slice(lines, 2, F.size(lines) - 1), F.slice(lines, 1, F.size(lines) - 1), lambda b, a: b - a)


def median_of(values: Column) -> Column:
    s = F.array_sort(values)
    half = F.size(s) - 1
    return (F.get(s, F.floor(half / 2).cast("int")) + F.get(s, F.ceil(half / 2).cast("int"))) / 2


def staff_confidence(lines: Column, ink: Column) -> Column:
    """How even the lines lie (3 parts) and how much ink they have (1 part), at most 1."""
    g = gaps(lines)
    mean = F.aggregate(g, F.lit(0.0), lambda a, v: a + v) / F.size(g)
    spread = F.sqrt(F.aggregate(g, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(g))
    even = F.greatest(F.lit(0.0), 1 - spread / F.greatest(median_of(g), F.lit(1.0)))
    return F.round(F.least(F.lit(1.0), 0.75 * even + 0.25 * F.least(8 * ink, F.lit(1.0))), 3)


def head_confidence(y: Column, top: Column, bottom: Column, width: Column, interline: Column) -> Column:
    """From how near the width is to 0.85 of a space and whether the head lies in its staff."""
    size = 1 - 2 * F.abs(width / interline - 0.85)
    # nine places first: halves then round up whatever their last bit is
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (size + F.when(y.between(top, bottom), 0.9).otherwise(0.6)) / 2)), 9), 2)


def row_offset(y: Column, last_line: Column, interline: Column) -> Column:
    return (y - last_line) / interline


# Limits of the page profile.
BINARY, UNEVEN, BLURRED, FLAT = 0.96, 90.0, 35.0, 38.0


def page_profile(binary: Column, illumination: Column, blur: Column) -> Column:
    return F.when(binary > BINARY, "already_binary").when(illumination > UNEVEN, "uneven_lighting").when(blur < BLURRED, "low_resolution_or_blurred").otherwise("clean_scan")
