"""Artifacts as JSON lines, written whole or not at all, and read with what is missing left null."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifact(rows: DataFrame, path: str) -> str:
    """Rows as JSON lines in a new folder below `path`; returns the folder.

    The folder is listed under versions/ only after it is complete, so a reader
    never sees half a write, and the version before stays until then.
    """
    base = path.rstrip("/")
    folder = f"{base}/data/{uuid.uuid4().hex}"
    rows.write.json(folder)
    listed = rows.sparkSession.range(1).select(F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
    listed.write.mode("append").json(f"{base}/versions")
    return folder


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the version listed last; columns of `schema` that it does not have are null."""
    versions = spark.read.schema("folder string, at timestamp").json(f"{path.rstrip('/')}/versions")
    last = versions.agg(F.max_by("folder", F.struct("at", "folder"))).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).json(last)
