"""The header of a page as one row: eleven roles from the lines above its first staff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from ..functions import text as tx
from . import structure as st

# Fixed patterns: lines that name their role, in the order in which roles are looked for; words of a collection's name; numbers; a reference at the end.
PREFIXED = {"composer": r"^(?:Nhạc|Music|Composer)\s*:\s*", "lyricist": r"^(?:Lời|Lyrics|Lyricist)\s*:\s*", "translator": r"^(?:Dịch|Lời dịch|Lời Việt|LV|Phỏng dịch|PD|Translator)\s*:\s*", "note": r"^(?:Chú thích|Ghi chú|Note)\s*:\s*"}
MARKED = {"tempo": r"^(?:Allegro|Andante|Moderato|Adagio|Tempo|Chậm|Nhanh|Vừa phải)(?:[^\p{L}\p{N}_]|$)", "key_info": r"^(?:Giọng|Key)(?:[^\p{L}\p{N}_]|$)"}
COLLECTION = r"tôn vinh|thánh ca|tuyển tập|hymnal|ca nguyện"
NUMBER, LEADING = r"^#?\d{1,4}[A-Za-z]?$", r"^(#?\d{1,4}[A-Za-z]?)\s+(\S.*)$"
SCRIPTURE = tx.SCRIPTURE
#: Share of the page's width from which the centre of a line without a prefix may be that of a composer.
RIGHT = 0.62


def model(lines: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """keys and one column of text for each role; null where a page has no line for it.

    lines: keys, nth, text, x1, y1, x2, y2. Lines go by their middle, then from
    left to right. Lines that are a short chord, and empty ones, have no role;
    a page of no other lines has no row.
    The first line that names a role has it and is no other; the title is the
    best of the rest with near lines of like height and case; a number before
    the title is the hymn's. A page is read by one sort of its few lines.
    """
    w = Window.partitionBy(*keys)
    text = F.trim("text")
    l = lines.where((text != "") & ~(music.is_chord(text) & (F.length("text") <= 7)))
    l = l.withColumns({"text": text, "h": F.col("y2") - F.col("y1"), "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    l = l.withColumn("at", F.struct("cy", "cx", "nth"))
    first = lambda rule: rule & (F.col("at") == F.min(F.when(rule, F.col("at"))).over(w))
    l = l.withColumns({f"is_{r}": F.coalesce(first(F.col("text").rlike("(?iu)" + p)), F.lit(False)) for r, p in (PREFIXED | MARKED).items()})
    explicit = F.lit(False)
    for r in PREFIXED | MARKED:
        explicit = explicit | F.col(f"is_{r}")
    l = l.withColumns({"explicit": explicit, "is_number": F.coalesce(first(F.col("text").rlike(NUMBER)), F.lit(False))})
    l = l.withColumn("open", ~F.col("explicit") & ~F.col("is_number"))
    l = l.withColumns({"mh": F.max(F.when(F.col("open"), F.col("h"))).over(w), "upper": st.tx.uppercase_ratio(F.col("text"))})
    rank = st.title_score(F.col("h"), F.col("mh"), F.col("text"), F.col("x2") - F.col("x1"), F.col("cx"), F.lit(page_width))
    l = l.withColumn("rank", F.when(F.col("open"), F.round(rank, 12)))
    top = F.max(F.col("rank")).over(w)
    l = l.withColumn("best", F.col("rank") == top)
    l = l.withColumn("title", F.min(F.when(F.col("best"), F.struct("at", "h", "cy", "upper"))).over(w))
    like = (F.col("h") / F.greatest(F.col("title.h"), F.lit(1.0))).between(*st.SAME_HEIGHT) & (F.abs(F.col("upper") - F.col("title.upper")) < st.SAME_CASE) & (F.abs(F.col("cy") - F.col("title.cy")) <= st.NEAR * F.greatest("h", F.col("title.h")))
    l = l.withColumns({"is_best": F.coalesce(F.col("at") == F.col("title.at"), F.lit(False)), "is_title": F.coalesce(F.col("open") & ((F.col("at") == F.col("title.at")) | like), F.lit(False))})
    above = F.coalesce(F.col("cy") < F.col("title.cy"), F.lit(True))
    l = l.withColumn("is_collection", F.coalesce(first(~F.col("is_best") & ~F.col("is_number") & above & F.lower("text").rlike(COLLECTION)), F.lit(False)))
    free = F.col("open") & ~F.col("is_title") & ~F.col("is_collection")
    right = free & (F.col("cy") > F.col("title.cy")) & (F.col("cx") > page_width * RIGHT) & ~F.max("is_composer").over(w)
    l = l.withColumn("by_place", F.coalesce(right & (F.col("at") == F.max(F.when(right, F.col("at"))).over(w)), F.lit(False)))
    below = F.coalesce(F.col("cy") > F.max(F.when(F.col("is_collection"), F.col("cy"))).over(w), F.lit(True))
    l = l.withColumn("is_description", free & ~F.col("by_place") & above & below)
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(role), F.struct("at", "text")))), lambda s: s["text"]), " ")
    one = lambda role: F.max(F.when(F.col(role), F.col("text")))
    bare = {r: F.max(F.when(F.col(f"is_{r}"), F.regexp_replace("text", "(?iu)" + p, ""))) for r, p in PREFIXED.items()}
    p = l.groupBy(*keys).agg(
        one("is_collection").alias("collection"), one("is_number").alias("number"), joined("is_title").alias("title"), joined("is_description").alias("described"),
        F.coalesce(bare["composer"], one("by_place")).alias("composer"), *[bare[r].alias(r) for r in PREFIXED if r != "composer"], *[one(f"is_{r}").alias(r) for r in MARKED])
    led = F.col("number").isNull() & F.col("title").rlike(LEADING)
    reference = F.btrim(tx.scripture(F.col("described")), F.lit(" —–"))
    rest = F.rtrim(F.regexp_replace("described", SCRIPTURE, ""))
    empty = lambda c: F.nullif(c, F.lit(""))
    return p.select(
        *keys, "collection", F.when(led, F.regexp_extract("title", LEADING, 1)).otherwise(F.col("number")).alias("hymn_number"),
        empty(F.when(led, F.regexp_extract("title", LEADING, 2)).otherwise(F.col("title"))).alias("title"),
        empty(F.when(tx.has_scripture(F.col("described")), F.regexp_replace(rest, "[ —–]+$", "")).otherwise(F.col("described"))).alias("description"),
        empty(reference).alias("scripture_reference"), "composer", "lyricist", "translator", "tempo", "key_info", "note")


def _same(fields: list[str], truth: Callable[[str], Column], predicted: Callable[[str], Column]) -> Column:
    same: Column = sum((F.when(F.coalesce(truth(f), F.lit("")) == F.coalesce(predicted(f), F.lit("")), 1.0).otherwise(0.0) for f in fields), F.lit(0.0))
    return F.round(same / len(fields), 6).alias("header_field_accuracy")


def field_accuracy(truth: DataFrame, predicted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Share of fields that are equal (missing counts as empty), per row of truth."""
    other = predicted.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return truth.join(other, keys, "left").select(*keys, _same(fields, F.col, lambda f: F.col(f"_{f}")))


def accuracy_within(lines: DataFrame, read: Column, keys: list[str], fields: list[str], page_width: float) -> DataFrame:
    """field_accuracy() of the headers of lines (as for model()) against those of the same lines with `read` as their text; both are made where the lines are, and nothing is joined."""
    both = lines.withColumn("_side", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("text")), F.struct(F.lit(1).alias("n"), read.alias("text")))))
    both = both.withColumn("text", F.col("_side.text")).withColumn("_side", F.col("_side.n"))
    rows = model(both, [*keys, "_side"], page_width)
    of = lambda side, f: F.max(F.when(F.col("_side") == side, F.col(f)))
    pages = rows.groupBy(*keys).agg(F.count_if(F.col("_side") == 0).alias("_pages"), *[of(0, f).alias(f) for f in fields], *[of(1, f).alias(f"_{f}") for f in fields])
    return pages.where("_pages > 0").select(*keys, _same(fields, F.col, lambda f: F.col(f"_{f}")))
