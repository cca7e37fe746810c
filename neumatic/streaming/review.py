"""The review log as a stream: running totals, exactly-once confirmations, per-score folding with undo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import review as ops

FOLDED = "score_id long, measure_no long, status string"
STATE = "measures array<long>, statuses array<string>"


def seconds_per_window(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Human seconds of each score and event-time window; events later than `late` are left out."""
    timed = log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "score_id")
    return timed.agg(F.sum(F.greatest(F.lit(0.0), "seconds")).alias("seconds")).select(F.col("w.start").alias("start"), "score_id", "seconds")


def confirmed_once(corrections: DataFrame, late: str = "1 day") -> DataFrame:
    """Each confirming event once, however often it is delivered within the watermark."""
    return corrections.withWatermark("at", late).dropDuplicatesWithinWatermark(["book", "before", "after", "context", "event"])


def folded(log: DataFrame) -> DataFrame:
    """Status changes of measures, with state per score because an undo clears all its decisions.

    Each trigger emits the new status of every measure that changed; undone
    ones become open. Events of a trigger are applied in order of time and id.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now: dict[int, str] = dict(zip(*map(list, state.get))) if state.exists else {}
        events = pd.concat(list(batches)).sort_values(["at", "event_id"])
        changed = {}
        for action, measure in zip(events["action"], events["measure_no"]):
            if action == "undo":
                changed |= {m: "open" for m in now}
                now = {}
            else:
                now[measure] = changed[measure] = ops.STATUS[action]
        state.update((list(now), list(now.values())))
        yield pd.DataFrame([(key[0], m, s) for m, s in changed.items()], columns=["score_id", "measure_no", "status"])

    return ops.valid(log).groupBy("score_id").applyInPandasWithState(fold, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def landed(new: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Artifacts not yet processed with their content hash at this pipeline version; for use in foreachBatch."""
    return new.join(done.where(F.col("version") == version).select("source_sha256").distinct(), "source_sha256", "left_anti")
