"""Lyric structure and page headers: trees, stanzas, continuity, merges, header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Weights and limits of the title rules.
HEIGHT, UPPER, WIDTH, CENTRE, TITLE_WIDTH = 0.42, 0.33, 0.15, 0.10, 0.55
SAME_HEIGHT, SAME_CASE, NEAR, COMPOSER_X = (0.8, 1.25), 0.2, 1.5, 0.62


def ordered_struct(order: list[str], *fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))


def tree(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, missing verses and verses → lines → syllables as nested arrays.

    words: keys, section, verse_count, verse, page, staff, pos, text.
    """
    lines = words.groupBy(*keys, "section", "verse_count", "verse", "page", "staff").agg(F.min("pos").alias("first"), F.transform(ordered_struct(["pos"], "text"), lambda x: x["text"]).alias("syllables"))
    verses = lines.groupBy(*keys, "section", "verse_count", "verse").agg(F.transform(ordered_struct(["first"], "page", "staff", "syllables"), lambda x: F.struct(x["page"].alias("page"), x["staff"].alias("staff"), x["syllables"].alias("syllables"))).alias("lines"))
    sections = verses.groupBy(*keys, "section", "verse_count").agg(F.array_sort(F.collect_list(F.struct("verse", "lines"))).alias("verses"))
    have = F.transform("verses", lambda v: v["verse"])
    return sections.withColumn("missing", F.array_except(F.sequence(F.lit(1).cast("long"), F.col("verse_count").cast("long")), have))


def stanzas(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows below the last staff with their stanza number, null before the first.

    rows: keys, row, verse (of a marker, else null), centre, height, bottom (of
    the last staff), interline. A marker of verse 2 or more begins a stanza if
    one is open or the row lies far off: more than 3 row heights below what is
    above it, or 12 staff spaces below the staff.
    """
    w = Window.partitionBy(*keys).orderBy("row")
    far = (F.col("centre") - F.coalesce(F.lag("centre").over(w), F.col("bottom")) > 3 * F.col("height")) | (F.col("centre") - F.col("bottom") > 12 * F.col("interline"))
    marker = F.coalesce(F.col("verse") >= 2, F.lit(False))
    # a stanza is open from the first marked row that is far off
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max((marker & far).cast("int")).over(upto)
    r = rows.withColumn("far", far).withColumn("open", begun == 1).withColumn("starts", (marker & F.col("open")).cast("long"))
    number = F.sum("starts").over(upto)
    return r.withColumn("stanza", F.when(number > 0, number)).drop("far", "open", "starts")


def projected(template: DataFrame, stanza_words: DataFrame, keys: list[str]) -> DataFrame:
    """Stanza words with the anchor of the template word at the same place, if both have as many words and all of the template are accepted.

    template: keys, place, anchor, accepted; stanza_words: keys, stanza, place.
    """
    t = template.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and("accepted").alias("all_accepted"))
    s = stanza_words.groupBy(*keys, "stanza").agg(F.count("*").alias("m"))
    fits = s.join(t, keys, "left").select(*keys, "stanza", F.coalesce((F.col("n") == F.col("m")) & F.col("all_accepted"), F.lit(False)).alias("fits"))
    j = stanza_words.join(fits, [*keys, "stanza"]).join(template.select(*keys, "place", "anchor"), [*keys, "place"], "left")
    return j.withColumns({"anchor": F.when(F.col("fits"), F.col("anchor")), "reason": F.when(~F.col("fits"), "stanza_template_mismatch")}).drop("fits")


def continued(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, page, last_is_chorus, explicit, verses) with `chorus`: the page goes on with the chorus of the page before.

    A page is a single continued chorus if it has no marker of its own and one
    verse row, and the chain before it, unbroken, began with a page that ends in a chorus.
    """
    w = Window.partitionBy(*keys).orderBy("page")
    able = ~F.col("explicit") & (F.col("verses") == 1)
    # chains of pages that can inherit; the page before a chain decides for all of it
    p = pages.withColumn("able", able).withColumn("chain", F.sum((~F.col("able")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "chain").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("chorus", F.col("able") & F.coalesce(F.bool_or("last_is_chorus").over(inside), F.lit(False))).drop("able", "chain")


# How near a word lies to a chorus row, another to its column, and how far that one is off the row (heights of a word).
SAME_ROW, SAME_COLUMN, OTHER_ROW = 0.6, 0.6, 0.7


def connected(words: DataFrame, keys: list[str]) -> DataFrame:
    """words with `section`, `reason` and `review`: choruses that go on over page breaks.

    words: keys, page, seq, system, x, y, h, section_type, verse, explicit. A
    page goes on with the chorus if the last word (the rightmost of the last
    system) of the page just before is in it, and it has no marker of its own
    and words of one verse only; then all of its words are chorus, and the first
    is to be reviewed. On the page before, the row of the chorus is walked back
    from its first word: words left of it on its height join the chorus, up to
    the first that shares its column with a word of another row.
    """
    page = [*keys, "page"]
    w = words.withColumn("_last_system", F.max("system").over(Window.partitionBy(*page)))
    tail = F.col("system") == F.col("_last_system")
    ends = w.groupBy(*page).agg(
        F.max_by(F.when(tail, F.col("section_type") == "chorus"), F.when(tail, F.struct("x", -F.col("seq")))).alias("last_is_chorus"),
        F.bool_or("explicit").alias("explicit"), F.countDistinct("verse").alias("verses"), F.min("seq").alias("_first"))
    follows = F.coalesce(F.col("page") == F.lag("page").over(Window.partitionBy(*keys).orderBy("page")) + 1, F.lit(False))
    pages = continued(ends.withColumn("explicit", F.col("explicit") | ~follows), keys)
    goes_on = F.coalesce(F.lead("chorus").over(Window.partitionBy(*keys).orderBy("page")), F.lit(False))
    pages = pages.withColumn("_goes_on", goes_on).select(*page, "chorus", "_goes_on", "_first")
    w = w.join(pages, page)
    chorus = F.when(F.col("_tail") & (F.col("section_type") == "chorus"), F.lit(True))
    w = w.withColumn("_tail", tail & F.col("_goes_on") & ~F.col("chorus"))
    row = w.where("_tail").groupBy(*page).agg(
        F.median(F.when(chorus, F.col("y"))).alias("_y"), F.median(F.when(chorus, F.col("h"))).alias("_h"), F.min(F.when(chorus, F.col("x"))).alias("_x"),
        F.collect_list(F.struct("x", "y")).alias("_others"))
    near = w.where("_tail").join(row, page).where((F.abs(F.col("y") - F.col("_y")) < SAME_ROW * F.col("_h")) & (F.col("x") < F.col("_x")))
    shared = F.exists("_others", lambda o: (F.abs(o["x"] - F.col("x")) < SAME_COLUMN * F.col("_h")) & (F.abs(o["y"] - F.col("_y")) > OTHER_ROW * F.col("_h")))
    back = Window.partitionBy(*page).orderBy(F.desc("x"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = near.withColumn("_met", F.sum(shared.cast("int")).over(back)).where("_met = 0").select(*page, "seq", F.lit(True).alias("_joined"))
    w = w.join(joined, [*page, "seq"], "left")
    reason = F.when(F.col("chorus"), "previous_page_chorus").when(F.col("_joined"), "single_row_tail_before_page_break")
    review = F.when(F.col("chorus"), F.col("seq") == F.col("_first")).when(F.col("_joined"), True).otherwise(False)
    return w.withColumns({"section": F.when(reason.isNotNull(), "chorus").otherwise(F.col("section_type")), "reason": reason, "review": review}).select(*words.columns, "section", "reason", "review")


def title_score(height: Column, max_height: Column, text: Column, width: Column, centre: Column, page_width: Column) -> Column:
    """How much a header line looks like the title: height, capitals, width, centring."""
    return (HEIGHT * F.least(height / max_height, F.lit(1.0)) + UPPER * tx.uppercase_ratio(text) + WIDTH * F.least(width / F.greatest(page_width * TITLE_WIDTH, F.lit(1.0)), F.lit(1.0))
            + CENTRE * (1 - F.least(F.abs(centre - page_width / 2) / (page_width / 2), F.lit(1.0))))


def titles(lines: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """lines (keys, nth, text, x1, y1, x2, y2, score) with `is_title`: the best line and the near ones of like height and case."""
    w = Window.partitionBy(*keys)
    h, width = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    l = lines.withColumns({"h": h, "cy": (F.col("y1") + F.col("y2")) / 2, "upper": tx.uppercase_ratio(F.col("text"))}).withColumn("mh", F.max("h").over(w))
    l = l.withColumn("rank", title_score(F.col("h"), F.col("mh"), F.col("text"), width, (F.col("x1") + F.col("x2")) / 2, F.lit(page_width)))
    best = F.max_by(F.struct("nth", "h", "cy", "upper"), F.struct("rank", -F.col("nth"))).over(w)
    l = l.withColumn("best", best)
    like = (F.col("h") / F.greatest(F.col("best.h"), F.lit(1.0))).between(*SAME_HEIGHT) & (F.abs(F.col("upper") - F.col("best.upper")) < SAME_CASE) & (F.abs(F.col("cy") - F.col("best.cy")) <= NEAR * F.greatest("h", F.col("best.h")))
    return l.withColumn("is_title", (F.col("nth") == F.col("best.nth")) | like).select(*lines.columns, "rank", "is_title")


def assembled(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Text, box and least confidence of the title lines of a page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "text"))), lambda x: x["text"]), " ")
    return lines.where("is_title").groupBy(*keys).agg(text.alias("title"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("score").alias("confidence"))
