"""Headers of pages as roles, on hand-made pages."""

import random

from pyspark.sql import functions as F

from neumatic.functions import text
from neumatic.operators import headers

ROLES = ["collection", "hymn_number", "title", "description", "scripture_reference", "composer", "lyricist", "translator", "tempo", "key_info", "note"]
S = "k int, nth int, text string, x1 double, y1 double, x2 double, y2 double"


def page(k, *lines):
    return [(k, i, text, x, 40.0 * i, x + 8.0 * len(text or ""), 40.0 * i + h) for i, (text, x, h) in enumerate(lines)]


def test_roles(spark):
    rows = page(1, ("Tuyển tập Mùa Xanh", 300.0, 14.0), ("Ngày mới bắt đầu — Sông Dài 4:12", 250.0, 14.0), ("27 BÀI CA BUỔI SÁNG", 400.0, 30.0), ("Nhạc: Trần Gió", 700.0, 12.0), ("Lời: Lê Mây", 80.0, 12.0), ("Lời Việt: Hồ Sao", 80.0, 12.0), ("Moderato", 80.0, 12.0), ("Key: G", 80.0, 12.0), ("Ghi chú: hát hai lần", 80.0, 12.0), ("Am7", 100.0, 12.0))
    rows += page(2, ("#12a", 60.0, 14.0), ("HAI DÒNG", 420.0, 28.0), ("TỰA ĐỀ", 430.0, 28.0), ("Người Viết", 760.0, 12.0), ("Người Sau", 800.0, 12.0))
    rows += page(3, ("Am", 100.0, 12.0), ("", 100.0, 12.0), (None, 100.0, 12.0)) + page(4, ("Lời: Chỉ Có Lời", 80.0, 12.0))
    got = {r["k"]: [r[c] for c in ROLES] for r in headers.model(spark.createDataFrame(rows, S).repartition(5), ["k"], 1000.0).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1] == ["Tuyển tập Mùa Xanh", "27", "BÀI CA BUỔI SÁNG", "Ngày mới bắt đầu", "Sông Dài 4:12", "Trần Gió", "Lê Mây", "Hồ Sao", "Moderato", "Key: G", "hát hai lần"]
    assert got[2] == [None, "#12a", "HAI DÒNG TỰA ĐỀ", None, None, "Người Sau", None, None, None, None, None]
    assert got[4] == [None, None, None, None, None, None, "Chỉ Có Lời", None, None, None, None]


def test_field_accuracy(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, None)], "k int, title string, composer string")
    b = spark.createDataFrame([(1, "x", ""), (2, "z", "y"), (4, "q", "q")], "k int, title string, composer string")
    got = {r["k"]: r["header_field_accuracy"] for r in headers.field_accuracy(a, b, ["k"], ["title", "composer"]).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 1.0}


def test_queries(spark):
    from neumatic.queries import queries

    sf = "/root/testdata/sf0.001"
    r = queries()["a20_header_roles"](spark, sf)
    counts = r.agg(*[F.count(c).alias(c) for c in ROLES]).first().asDict()
    assert all(counts.values())
    assert 0 < queries()["q18_header_accuracy"](spark, sf).agg(F.avg("header_field_accuracy").alias("a")).first()["a"] < 1


def test_references_are_looked_for_where_they_can_be(spark):
    rng = random.Random(6)
    parts = ["Gioan", "1 Cor", "III I", " ", "  ", "—", "–", ",", ":", "3:16", "12:3", "1234:5", "5:1234", "”", "'", "\n", "x" * 30, "a b", "é"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) + rng.choice([" 3:16", " 3:16” ", "", " 7:2\n", ":4"]) for _ in range(4000)] + [None]
    found, ended, n = F.regexp_extract("t", text.SCRIPTURE, 1), F.col("t").rlike(text.SCRIPTURE), 0
    for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", found.alias("a"), F.coalesce(text.scripture(F.col("t")), F.lit("")).alias("b"), ended.alias("c"), text.has_scripture(F.col("t")).alias("d")).collect():
        assert (r["a"] or "", r["c"]) == (r["b"], r["d"])
        n += bool(r["b"])
    assert n > 500


def test_headers_of_both_readings_are_made_where_the_lines_are(spark, tmp_path):
    from pyspark.sql import functions as F

    from neumatic.operators import headers as ops
    from neumatic.plans import headers as plans
    from neumatic.queries import queries

    rows = [(i, " ".join("abcdefgh"[(i + j) % 8] * (1 + j % 7) for j in range(40 + 9 * i)), "en") for i in range(1, 9)] + [(20, "", "en"), (21, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    truth, keys = plans.pages(spark, str(tmp_path)), ["score_id", "page"]
    read = F.when((F.col("score_id") + F.col("nth")) % 3 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    want = ops.field_accuracy(ops.model(truth, keys, 1000.0), ops.model(truth.withColumn("text", read), keys, 1000.0), keys, plans.FIELDS)
    got = ops.accuracy_within(truth, read, keys, plans.FIELDS, 1000.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len({r["header_field_accuracy"] for r in got.collect()}) > 1
    plan = queries()["q18_header_accuracy"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
