"""Numbering and exports of groups of any size, and orders that keep long names whole."""

import random

from pyspark.sql import functions as F

from neumatic.functions import text
from neumatic.operators import tables


def test_numbers_of_hot_groups_and_common_beginnings(spark):
    rng = random.Random(2)
    rows = [("hot", f"Customer#{rng.randint(0, 10**9):012d}", i, "mine") for i in range(6000)] + [(rng.choice(["a", "b", None]), rng.choice(["", "x", None, "y"]), i, "mine") for i in range(6000, 6300)]
    frame = spark.createDataFrame(rows, "book string, title string, score_id long, place_ string").repartition(7)
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tables.numbered(frame, ["book"], ["title", "score_id"])
        got = {(r["book"], r["place"]): r["score_id"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    assert out.columns == ["book", "title", "score_id", "place_", "place"] and len(got) == len(rows)
    for book in ("hot", "a", "b", None):
        order = sorted((r for r in rows if r[0] == book), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        assert [got[book, i + 1] for i in range(len(order))] == [r[2] for r in order]
    assert not tables.numbered(frame.where("false"), ["book"], ["title"]).count()
    whole = {r["score_id"]: r["place"] for r in tables.numbered(frame, [], [F.col("score_id").desc()]).collect()}
    assert whole == {i: 6300 - i for i in range(6300)}


def test_contents_of_a_large_book_with_long_titles(spark):
    scores = spark.range(12000).select(F.lit("B").alias("book"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" a title of more than thirty letters")).alias("title"), (F.col("id") + 10**9).alias("score_id"))
    lines = {r["place"]: r["line"] for r in tables.contents(scores).collect()}
    assert lines[10001] == "10001  010000 a title of more than thirty letters1000010000" and lines[12001] == "TOTAL    12000"
    assert lines[1].startswith("   1  ")


def test_natural_order_of_long_numbers(spark):
    names = ["page-2", "page-10", "page-02", f"page-{10**15}", f"page-{10**15 - 1}", "page-", "page-2b", "page-2a", "a"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "page-", "page-02", "page-2", "page-2a", "page-2b", "page-10", f"page-{10**15 - 1}", f"page-{10**15}"]


def test_dealt_items_meet_without_a_nested_loop(spark):
    from neumatic.queries import queries

    plan = queries()["d1_edit_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
