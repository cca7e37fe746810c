"""Positional, nearest, as-of, range and gap-filling joins.

Every join is equi on its group key first; the rest is a residual condition,
so no pair is made across groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """The k-th row of each side in a group side by side; `complete` tells groups whose sides have equal counts."""
    at = lambda f, o: f.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)))
    a, b = at(left, left_order).withColumn("in_left", F.lit(True)), at(right, right_order).withColumn("in_right", F.lit(True))
    both = a.join(b, [*keys, "ordinal"], "full")
    whole = F.bool_and(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).over(Window.partitionBy(*keys))
    return both.withColumn("complete", whole).drop("in_left", "in_right")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], left_x: str, right_x: str, value: list[str], tie: str, within: float | None = None) -> DataFrame:
    """For each left row the right row of its group with the least |left_x - right_x|; ties go to the smallest `tie`.

    The nearest row is the last at or before the place or the first after it,
    so both sides are sorted together once per group and no pairs are made.
    """
    ids = [c for c in left_id if c not in keys]
    at = F.struct(F.col(right_x).cast("double").alias("x"), F.col(tie).alias("tie"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(value)])
    marks = right.where(F.col(right_x).isNotNull()).groupBy(*keys, F.col(right_x).cast("double").alias("x")).agg(F.min_by(at, F.col(tie)).alias("mark"))
    kind = marks.schema["mark"].dataType
    points = left.where(F.col(left_x).isNotNull()).select(*keys, F.col(left_x).cast("double").alias("x"), F.lit(None).cast(kind).alias("mark"), F.struct(*ids, F.lit(True).alias("is_point")).alias("point"))
    both = points.unionAll(marks.select(*keys, "x", "mark", F.lit(None).cast(points.schema["point"].dataType).alias("point")))
    order = lambda *by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    is_point = F.col("point").isNotNull()
    both = both.withColumns({"before": F.last("mark", True).over(order(F.col("x"), is_point)), "after": F.last("mark", True).over(order(F.desc("x"), is_point))})
    pick = lambda m: F.when(F.col(m).isNotNull(), F.struct(F.abs(F.col(f"{m}.x") - F.col("x")).alias("distance"), F.col(f"{m}.tie").alias("tie"), F.col(m).alias("mark")))
    found = both.where(is_point).select(*keys, "point", F.least(pick("before"), pick("after")).alias("best")).where("best is not null")
    if within is not None:
        found = found.where(F.col("best.distance") <= within)
    return found.select(*[c for c in left_id if c in keys], *[F.col(f"point.{c}").alias(c) for c in ids], F.col("best.distance").alias("distance"), *[F.col(f"best.mark.v{i}").alias(v) for i, v in enumerate(value)])


def interpolated(points: DataFrame, anchors: DataFrame, keys: list[str], x: str, value: str, ident: str) -> DataFrame:
    """Value of each point between the anchors before and after it; the nearer end's value outside. One shuffle, no pairs."""
    p = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(ident).alias("id"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("is_point"))
    a = anchors.select(*keys, F.col(x).cast("double").alias("x"), F.lit(None).cast("long").alias("id"), F.col(value).cast("double").alias("v"), F.lit(0).alias("is_point"))
    back = Window.partitionBy(*keys).orderBy("x", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("x"), "is_point").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("is_point") == 0, F.struct("x", "v"))
    u = p.unionByName(a).withColumns({"prev": F.last(mark, ignorenulls=True).over(back), "next": F.last(mark, ignorenulls=True).over(ahead)}).where("is_point = 1")
    x0, x1, v0, v1 = F.col("prev.x"), F.col("next.x"), F.col("prev.v"), F.col("next.v")
    out = F.when(F.col("prev").isNull(), v1).when(F.col("next").isNull(), v0).when(x1 == x0, v0).otherwise(v0 + (v1 - v0) * (F.col("x") - x0) / (x1 - x0))
    return u.select(*keys, F.col("id").alias(ident), out.alias("value"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], x: str, low: str, high: str, width: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of `inner` with the rows of `outer` of their group whose [low, high) holds x.

    With `width` (about the length of the spans) both sides are also keyed by
    cell of that width, a span in each cell that it meets, so that a row meets
    the spans of its own cell and not all of its group.
    """
    holds = (F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))
    if width is None:
        return inner.join(outer, keys, how).where(holds) if how == "inner" else inner.join(outer, [*[inner[k] == outer[k] for k in keys], holds], how)
    cell = lambda c: F.floor(c / F.lit(float(width)))
    spans = outer.where(F.col(high) > F.col(low)).withColumn("span_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    rows = inner.withColumn("row_cell", cell(F.col(x)))
    same = [rows[k] == spans[k] for k in keys]
    met = rows.join(spans, [*same, F.col("row_cell") == F.col("span_cell"), holds], how)
    return met.select(*[rows[c] for c in inner.columns], *([spans[c] for c in outer.columns if c not in keys] if how == "inner" else []))


def filled(base: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """base and those proposals whose key it does not have."""
    return base.unionByName(proposals.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def upserted(base: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with the edits' columns where there is an edit, and rows that only the edits have."""
    e = edits.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_edited"))
    j = base.join(e, keys, "full")
    rest = [c for c in base.columns if c not in (*keys, *columns)]
    return j.select(*keys, *[F.when(F.col("_edited"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], *rest)


def synced(local: DataFrame, remote: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What to do with each key so that local equals remote: insert, update, delete or keep."""
    a = local.select(F.col(key), F.struct(*columns).alias("mine"))
    b = remote.select(F.col(key), F.struct(*columns).alias("theirs"))
    action = F.when(F.col("mine").isNull(), "insert").when(F.col("theirs").isNull(), "delete").when(~F.col("mine").eqNullSafe(F.col("theirs")), "update").otherwise("keep")
    return a.join(b, key, "full").select(key, action.alias("action"))


def multiset_overlap(a: DataFrame, b: DataFrame, group: list[str], items: list[str]) -> DataFrame:
    """Per group: sizes of both multisets and of their intersection."""
    count = lambda f, n: f.groupBy(*group, *items).agg(F.count("*").alias(n))
    j = count(a, "n1").join(count(b, "n2"), [*group, *items], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.groupBy(*group).agg(F.sum(zero("n1")).alias("expected"), F.sum(zero("n2")).alias("actual"), F.sum(F.least(zero("n1"), zero("n2"))).alias("common"))


def f1(common: Column, expected: Column, actual: Column) -> Column:
    """Null when both are empty."""
    return F.when(expected + actual > 0, 2 * common / (expected + actual))


def agreement(mine: DataFrame, theirs: DataFrame, run: str, system: str) -> DataFrame:
    """Whether both engines have the same number of measures in every system of a run, in order."""
    counts = lambda f, name: f.groupBy(run, system).agg(F.count("*").alias("n")).groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(system, "n"))), lambda x: x["n"]).alias(name))
    j = counts(mine, "mine").join(counts(theirs, "theirs"), run, "left")
    return j.select(run, F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)).alias("agree"))
