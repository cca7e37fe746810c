"""Results computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, on a local master only (as in tests)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = context._jsc.sc().getCheckpointDir()
        if have.isEmpty() and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="neumatic-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def computed(frame: DataFrame) -> DataFrame:
    """frame.checkpoint(): computed once, also if executors are lost."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read again: its columns are packed, which a checkpoint's rows are not."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tasks_for(frame: DataFrame, rows: int) -> int:
    """As many tasks as hold some `rows` rows of a frame each, at least as many as shuffles have."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frame.count() // rows))


def beside(small: DataFrame, most: int = 100_000) -> DataFrame:
    """`small` for use in a join: computed once, and broadcast only if it has at most `most` rows."""
    small = computed(small)
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
