"""A score corpus derived from the star-schema, event and text tables.

Every query starts from these views, so its work grows with the given tables.
CORE_SQL states the same views for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.runs import block_of
from ..operators.shared import tasks_for

STEPS = "CDEFGAB"

# rows of a task where all of them are sorted or hashed: a task's memory stays the same, whatever the tables hold
EVENTS_OF_TASK, TEXTS_OF_TASK = 250_000, 2_500

CORE_SQL = """
WITH scores AS (
  SELECT c_custkey AS score_id, c_mktsegment AS book, c_name AS title, c_acctbal AS balance, c_nationkey AS nation FROM customer),
measures AS (
  SELECT o_custkey AS score_id, 'P1' AS part_id, o_orderkey AS measure_key,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS measure_idx,
    CASE WHEN o_orderkey % 4 = 0 THEN 2 + o_orderkey % 3 END AS beats, CASE WHEN o_orderkey % 4 = 0 THEN 4 END AS beat_type,
    CASE WHEN o_orderkey % 6 = 0 THEN 1 + o_orderkey % 2 END AS divisions_given, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 - 3 END AS fifths_given,
    o_orderkey % 7 = 0 AS new_page, o_orderkey % 5 = 0 AS new_system, CASE WHEN o_orderkey % 9 <> 0 THEN 100 + o_orderkey % 50 END AS width
  FROM orders),
raw_events AS (
  SELECT m.score_id, m.part_id, m.measure_key, m.measure_idx, l.*,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem l JOIN measures m ON l.l_orderkey = m.measure_key),
score_events AS (
  SELECT score_id, part_id, measure_key, measure_idx, seq,
    CASE l_suppkey % 10 WHEN 0 THEN 'backup' WHEN 1 THEN 'forward' WHEN 2 THEN 'harmony' ELSE 'note' END AS kind,
    1 + CAST(l_quantity AS BIGINT) % 4 AS duration, substr('CDEFGAB', CAST(l_partkey % 7 AS INT) + 1, 1) AS step,
    CASE WHEN l_partkey % 11 = 0 THEN 1 WHEN l_partkey % 13 = 0 THEN -1 ELSE 0 END AS alter_by,
    3 + l_suppkey % 3 AS octave, 1 + l_partkey % 2 AS voice, 1 + l_suppkey % 2 AS staff,
    l_returnflag = 'A' AND seq > 1 AS is_chord, l_linestatus = 'F' AND l_partkey % 5 = 0 AS is_rest, l_partkey % 17 = 0 AS is_grace,
    l_partkey % 19 = 0 AS tie_start, l_partkey % 23 = 0 AS tie_stop, l_suppkey % 9 = 3 AS slur_start, l_suppkey % 9 = 4 AS slur_stop,
    l_partkey % 29 = 0 AS is_tuplet, 20 * seq + 10 * l_discount AS x
  FROM raw_events),
notes AS (
  SELECT *, row_number() OVER (PARTITION BY measure_key ORDER BY seq) AS note_index FROM score_events WHERE kind = 'note'),
words AS (
  SELECT doc_id AS score_id, lang, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
tokens AS (
  SELECT score_id, lang, pos, text, pos // 32 AS page, pos // 8 AS line, 1 + (pos // 8) % 3 AS verse, 12 * (pos % 8) + length(text) AS x,
    1 - ((score_id * 31 + pos) % 40) / 100.0 AS confidence
  FROM words),
review_log AS (
  SELECT event_id, user_id AS score_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS measure_no, value AS seconds, ts AS at,
    CASE event_type WHEN 'view' THEN 'skip' WHEN 'signup' THEN 'accept' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'apply' ELSE 'undo' END AS action
  FROM events),
runs AS (SELECT conv_id AS run_id, turn AS page, role AS engine, text FROM conversations)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("score_id"), F.col("c_mktsegment").alias("book"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("score_id"), F.lit("P1").alias("part_id"), k.alias("measure_key"), F.row_number().over(order).cast("long").alias("measure_idx"),
        F.when(k % 4 == 0, 2 + k % 3).alias("beats"), F.when(k % 4 == 0, F.lit(4)).alias("beat_type"),
        F.when(k % 6 == 0, 1 + k % 2).alias("divisions_given"), F.when(k % 5 == 0, k % 7 - 3).alias("fifths_given"),
        (k % 7 == 0).alias("new_page"), (k % 5 == 0).alias("new_system"), F.when(k % 9 != 0, 100 + k % 50).alias("width"))


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, measures(spark, sf_dir).select("score_id", "part_id", "measure_key", "measure_idx"))


def events_of(spark: SparkSession, sf_dir: str, m: DataFrame, how: str = "inner") -> DataFrame:
    """Events with the columns of their measure in `m`; with how = "left" a measure without events gives one row without kind."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    tasks = tasks_for(li, EVENTS_OF_TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li = li.repartition(tasks, "l_orderkey")
    order = Window.partitionBy("measure_key").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = m.join(li, m["measure_key"] == li["l_orderkey"], how).withColumn("seq", F.row_number().over(order).cast("long"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return e.select(
        *m.columns, "seq",
        F.when(s.isNull(), None).when(s % 10 == 0, "backup").when(s % 10 == 1, "forward").when(s % 10 == 2, "harmony").otherwise("note").alias("kind"),
        (1 + F.col("l_quantity").cast("long") % 4).alias("duration"), F.substring(F.lit(STEPS), (p % 7).cast("int") + 1, F.lit(1)).alias("step"),
        F.when(p % 11 == 0, 1).when(p % 13 == 0, -1).otherwise(0).alias("alter_by"),
        (3 + s % 3).alias("octave"), (1 + p % 2).alias("voice"), (1 + s % 2).alias("staff"),
        ((F.col("l_returnflag") == "A") & (F.col("seq") > 1)).alias("is_chord"), ((F.col("l_linestatus") == "F") & (p % 5 == 0)).alias("is_rest"), (p % 17 == 0).alias("is_grace"),
        (p % 19 == 0).alias("tie_start"), (p % 23 == 0).alias("tie_stop"), (s % 9 == 3).alias("slur_start"), (s % 9 == 4).alias("slur_stop"),
        (p % 29 == 0).alias("is_tuplet"), (20 * F.col("seq") + 10 * F.col("l_discount")).alias("x"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = score_events(spark, sf_dir).where("kind = 'note'")
    return e.withColumn("note_index", F.row_number().over(Window.partitionBy("measure_key").orderBy("seq")).cast("long"))


def confidence() -> Column:
    return 1 - ((F.col("score_id") * 31 + F.col("pos")) % 40) / 100.0


def texts(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    """doc_id, lang and a value made of each text; those of one score are in one task, so that its words need not be moved."""
    d = table(spark, sf_dir, "documents")
    return d.where("text is not null").select("doc_id", "lang", value).repartition(tasks_for(d, TEXTS_OF_TASK), "doc_id")


def word_lists(spark: SparkSession, sf_dir: str, value: Callable[[Column], Column] = lambda text: text) -> tuple[DataFrame, int]:
    """score_id, lang, block and words (an array, of value(text)) of all texts, those of a score in one row, and the number of blocks.

    Texts are moved once, to their block. places has the words' places in their text where a score has several, which are merged by place; else it is null.
    """
    d = table(spark, sf_dir, "documents")
    blocks = tasks_for(d, TEXTS_OF_TASK)
    t = d.where("text is not null").select(F.col("doc_id").alias("score_id"), block_of(["doc_id"], blocks).alias("block"), "lang", "text").repartition(blocks, "block")
    t = t.groupBy("block", "score_id").agg(F.max("lang").alias("lang"), F.transform(F.collect_list("text"), value).alias("texts"))
    merged = F.array_sort(F.flatten(F.transform("texts", lambda x: F.zip_with(F.sequence(F.lit(1), F.size(F.split(x, " ", -1))), F.split(x, " ", -1), lambda i, w: F.struct(i.alias("i"), w.alias("w"))))))
    places = F.when(F.size("texts") != 1, F.transform(merged, lambda x: x["i"].cast("long") - 1))
    return t.select("score_id", "lang", "block", places.alias("places"), F.when(F.size("texts") == 1, F.split(F.get("texts", F.lit(0)), " ", -1)).otherwise(F.transform(merged, lambda x: x["w"])).alias("words")), blocks


def tokens(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """The words of all texts; with `together`, texts are moved (each once) so that all words of a score are in one task."""
    d = texts(spark, sf_dir, F.col("text")) if together else table(spark, sf_dir, "documents").where("text is not null")
    w = d.select(F.col("doc_id").alias("score_id"), "lang", F.posexplode(F.split("text", " ", -1)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    line = F.floor(F.col("pos") / 8)
    return w.select("score_id", "lang", "pos", "text", F.floor(F.col("pos") / 32).alias("page"), line.alias("line"), (1 + line % 3).alias("verse"),
                    (12 * (F.col("pos") % 8) + F.length("text")).alias("x"), confidence().alias("confidence"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """The review log of an events frame, batch or streaming."""
    t = F.col("event_type")
    action = F.when(t == "view", "skip").when(t == "signup", "accept").when(t == "click", "edit").when(t == "purchase", "apply").otherwise("undo")
    return events.select("event_id", F.col("user_id").alias("score_id"), F.get_json_object("props", "$.k").cast("long").alias("measure_no"), F.col("value").alias("seconds"), F.col("ts").alias("at"), action.alias("action"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("page"), F.col("role").alias("engine"), "text")
