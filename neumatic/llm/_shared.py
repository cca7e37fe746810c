"""The folder that driver and executors share, cutting lineage through it, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of our own, on a local master only (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="neumatic-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """frame.checkpoint() in the shared folder: computed once, and it survives lost executors."""
    _folder(frame.sparkSession)
    return frame.checkpoint()


def beside(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = 50_000) -> DataFrame:
    """big.join(small): broadcast if `small` has at most `most` rows when counted, else a join by key."""
    small = kept(small)
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def unused(names: list[str], stem: str) -> str:
    """stem, lengthened until no column of `names` has it (case aside)."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python tasks at most `rows` texts at once in this session: a batch of texts is held several times over on its way.

    The setting is read when the caller's action is planned, after the operator has returned, so it stays lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)
