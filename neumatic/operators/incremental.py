"""A table by score that is kept up to date: only scores whose content has changed are computed and written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import computed

BUCKETS = 256


def bucket_of(score: str = "score_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(score), F.lit(buckets)).cast("int")


def content_hashes(events: DataFrame, score: str = "score_id") -> DataFrame:
    """score_id, content: a hash of all rows of a score, whatever their order; repeated rows count."""
    rows = events.select(score, F.xxhash64(*sorted(c for c in events.columns if c != score)).alias("h"))
    return rows.groupBy(score).agg(F.sha2(F.concat_ws(":", F.sum(F.col("h").cast("decimal(38,0)")), F.sum((F.col("h") % 1000003 * (F.col("h") % 1000003)).cast("decimal(38,0)")), F.count("*")), 256).alias("content"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows below `path`, or None if nothing has been written."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = base.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if there.exists(base) else None


def update(spark: SparkSession, path: str, events: DataFrame, build: Callable[[DataFrame], DataFrame], *, version: str, score: str = "score_id", buckets: int = BUCKETS) -> DataFrame:
    """Bring the table below `path` up to date with `events`; returns what was done: score, action.

    build(events) gives rows with the score's column. A score is built again if
    its content, or the version, is not that of its rows in the table; rows of
    scores that are gone are removed. Rows lie in buckets of scores, and only
    buckets with a change are read and written (by dynamic partition overwrite,
    so each is replaced whole or not at all); all others stay as they are.
    Scores for which build() gives no row keep a row without values, by which
    they are known as done.
    """
    wanted = content_hashes(events, score).withColumn("version", F.lit(version))
    table = stored(spark, path)
    if table is not None:
        table = table.where(F.col(score).isNotNull())
    if table is None:
        actions = computed(wanted.select(score, "content", F.lit("build").alias("action")))
    else:
        have = table.select(score, F.col("content").alias("_had"), F.col("version").alias("_made")).distinct()
        both = wanted.join(have, score, "full")
        action = F.when(F.col("content").isNull(), "remove").when(F.col("_had").isNull(), "build").when((F.col("content") != F.col("_had")) | (F.col("version") != F.col("_made")), "rebuild")
        actions = computed(both.select(score, "content", action.alias("action")).where("action is not null"))
    fresh = actions.where("action <> 'remove'")
    made = build(events.join(fresh.select(score), score, "left_semi"))
    values = [c for c in made.columns if c != score]
    rows = fresh.select(score, "content").join(made, score, "left").withColumns({"version": F.lit(version), "bucket": bucket_of(score, buckets)})
    rows = rows.select(score, *values, "content", "version", "bucket")
    if table is not None:
        touched = [r["bucket"] for r in actions.select(bucket_of(score, buckets).alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        kept = table.where(F.col("bucket").isin(touched)).join(actions.select(score), score, "left_anti")
        rows = computed(rows.unionByName(kept))
        emptied = set(touched) - {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        if emptied:  # a bucket without rows would not be overwritten
            none = spark.createDataFrame([(b,) for b in sorted(emptied)], "bucket int")
            rows = rows.unionByName(none, allowMissingColumns=True)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return actions.select(score, "action")


def rows_of(spark: SparkSession, path: str, key: str, score: str = "score_id") -> DataFrame:
    """The table's rows: those with a `key`, without what it is kept up to date by."""
    return spark.read.parquet(path).where(F.col(score).isNotNull() & F.col(key).isNotNull()).drop("content", "version", "bucket")
