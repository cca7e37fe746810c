"""Hard-negative mining with segment summaries, in exact integers.

The vectors are written once, as integers, with the sum and the deviation of
each of their segments at several levels (few wide segments, then more narrow
ones). Over a segment of m components, the product of two vectors is
m * (mean * mean) plus at most and minus at most m * (deviation * deviation);
summed over the segments this bounds their score from both sides. A pair is
left out at the first level where its bounds show that it cannot count, and
only the pairs that pass all levels are scored exactly.

Anchors are a stated query set. They are split by a hash into blocks of some
`block` rows, and one block after the other is shared with all tasks (a
bounded size, whatever the number of anchors) and compared with all rows, in
two passes: the first finds each anchor's positives, the second the negatives
in each positive's window of scores. A task keeps, for each anchor and window,
the best rows that it has met; they are also what later rows must beat. The
last choice is a ranking over what the tasks kept. Each block's result is
written to the shared folder, so lineage doesn't grow.

Defined results: rows with a null key, label or vector, or a null or
non-finite component, take no part. A component x becomes floor(scale * x),
held to +-limit(components), so that scores fit in a long. Rows of another
vector length than the anchor's are not compared with it. Rows that share the
anchor's key are the anchor itself: neither its positives nor its negatives.
Rows that repeat otherwise each count, and an anchor row that repeats gives its
results as often. Anchors without positives, and positives without negatives
in their window (those with negative scores have an empty one), give no row.
Columns besides the three named ones take no part, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_path
from .centroids import limit, whole_vectors

LEVELS = (4, 16)
SLICE = 2048
BUFFER = 1 << 20


def _edges(dims: int, level: int) -> list[int]:
    """Starts of `level` segments of about the same length (fewer if there are fewer components), and the end."""
    n = min(level, dims)
    return [dims * i // n for i in range(n + 1)] if n else [0]


def summaries(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment: sum / sqrt(length), and sqrt(sum of squared differences from the mean), the latter rounded up."""
    edges = np.array(_edges(x.shape[1], level))
    if len(edges) < 2:
        return np.zeros((len(x), 0)), np.zeros((len(x), 0))
    length = np.diff(edges)
    f = x.astype(np.float64)
    total = np.add.reduceat(f, edges[:-1], axis=1)
    centred = f - np.repeat(total / length, length, axis=1)
    spread = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1))
    return total / np.sqrt(length), spread * (1 + 1e-9)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, x) with the means and deviations of all levels behind each other."""
    for batch in batches:
        lists = batch.column("x")
        sizes = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        means, spreads = [None] * len(lists), [None] * len(lists)
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            x = flat[(ends[at] - dims)[:, None] + np.arange(dims)]
            both = [summaries(x, level) for level in LEVELS]
            for i, m, s in zip(at, np.concatenate([b[0] for b in both], axis=1), np.concatenate([b[1] for b in both], axis=1)):
                means[i], spreads[i] = m, s
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means, pa.list_(pa.float64())), pa.array(spreads, pa.list_(pa.float64()))], names=["key", "label", "x", "mean", "spread"])


def _matrix(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    """The lists of the rows `at`, all of `width` elements, as a matrix."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return flat[offsets[at][:, None] + np.arange(width)]


class _Best:
    """The best rows of each slot met so far, and the score that a row must reach to count."""

    def __init__(self, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.parts: list[tuple] = []
        self.size = 0
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        good = score >= self.least[slot]
        if good.any():
            self.parts.append((slot[good], score[good], key[good]))
            self.size += int(good.sum())
            if self.size > max(BUFFER, 4 * self.slots * self.keep):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best of each slot; ties by smaller key."""
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        slot, score, key = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((key, -score, slot))
        slot, score, key = slot[order], score[order], key[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        good = place < self.keep
        slot, score, key, place = slot[good], score[good], key[good], place[good]
        full = place == self.keep - 1
        self.least[slot[full]] = score[full]
        self.parts, self.size = [(slot, score, key)], len(slot)
        return slot, score, key


class Anchors:
    """A block of anchors of one vector length, with their summaries; `low` and `high` are the windows of scores, [anchor, window]."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray):
        self.keys, self.labels, self.x, self.same, self.low, self.high = keys, labels, x, same, low, high
        self.levels = [summaries(x, level) for level in LEVELS]

    def pairs(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, mean: np.ndarray, spread: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs that may count: of the right label, not below `least` and not above the highest window."""
        alive = ((self.labels[:, None] == labels) == self.same) & (self.keys[:, None] != keys)
        top = self.high.max(axis=1).astype(np.float64)
        a, r = np.arange(len(self.keys)), np.arange(len(keys))
        at = 0
        for m, s in self.levels:
            n = m.shape[1]
            rows_m, rows_s = mean[r, at : at + n], spread[r, at : at + n]
            at += n
            middle, reach = m[a] @ rows_m.T, s[a] @ rows_s.T
            slack = 1 + 1e-9 * (np.abs(m[a]) @ np.abs(rows_m).T + reach)
            alive &= (middle + reach + slack >= least[a].astype(np.float64)[:, None]) & (middle - reach - slack <= top[a][:, None])
            more_a, more_r = alive.any(axis=1), alive.any(axis=0)
            a, r, alive = a[more_a], r[more_r], alive[more_a][:, more_r]
            if not len(a) or not len(r):
                return (np.empty(0, np.int64),) * 3
        left, right = np.nonzero(alive)
        xa, xr = self.x[a], x[r]
        most = int(np.abs(xa).max(initial=0)) * int(np.abs(xr).max(initial=0)) * x.shape[1]
        if most < 1 << 53 and len(left) * 20 > alive.size:  # doubles are exact
            score = (xa.astype(np.float64) @ xr.T.astype(np.float64))[left, right].astype(np.int64)
        else:
            score = np.empty(len(left), np.int64)
            for i in range(0, len(left), 1 << 15):
                score[i : i + (1 << 15)] = np.einsum("ij,ij->i", xa[left[i : i + (1 << 15)]].astype(np.int64), xr[right[i : i + (1 << 15)]].astype(np.int64))
        return a[left], r[right], score


def _compare(shared, keep: int):
    """Batches of the written rows to the best `keep` rows of each anchor and window in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, Anchors] = shared.value
        best = {dims: _Best(g.low.size, keep) for dims, g in groups.items()}
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy()
            keys, labels = batch.column("key").to_numpy(), batch.column("label").to_numpy()
            for dims, g in groups.items():
                found = np.flatnonzero(sizes == dims)
                wide = sum(len(_edges(dims, level)) - 1 for level in LEVELS)
                for i in range(0, len(found), SLICE):
                    at, have = found[i : i + SLICE], best[dims]
                    windows = g.low.shape[1]
                    least = np.maximum(g.low, have.least.reshape(-1, windows)).min(axis=1)
                    a, r, score = g.pairs(keys[at], labels[at], _matrix(batch.column("x"), at, dims), _matrix(batch.column("mean"), at, wide), _matrix(batch.column("spread"), at, wide), least)
                    for w in range(windows):
                        inside = (score >= g.low[a, w]) & (score <= g.high[a, w])
                        have.add(a[inside] * windows + w, score[inside], keys[at][r[inside]])
                    if i == 0:
                        have.settle()
        for dims, g in groups.items():
            slot, score, key = best[dims].settle()
            windows = max(1, g.low.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), dims, np.int32)), pa.array((slot // windows).astype(np.int32)), pa.array((slot % windows).astype(np.int32)), pa.array(score), pa.array(key)], names=["dims", "anchor", "win", "score", "key"])

    return run


def _ranked(rows: DataFrame, groups: dict[int, Anchors], keep: int) -> DataFrame:
    """(dims, anchor, win, score, key, rank): the best `keep` rows of each anchor and window over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(groups)
    met = rows.select("key", "label", "x", "mean", "spread").mapInArrow(_compare(shared, keep), "dims int, anchor int, win int, score long, key long")
    order = Window.partitionBy("dims", "anchor", "win").orderBy(F.desc("score"), "key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score s with low * score <= 100 s <= high * score, exactly."""
    fit = lambda v: max(-(1 << 62), min(1 << 62, v))
    least = [fit(-(-low * int(p) // 100)) for p in scores]
    most = [fit(high * int(p) // 100) for p in scores]
    return np.array(least, np.int64), np.array(most, np.int64)


def mine(
    vectors: DataFrame, anchors: Column, *, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    positives: int = 5, keep: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), `anchors` saying which rows are anchors.

    For each anchor's first `positives` rows of its label: the first `keep`
    rows of other labels whose score s has low * p <= 100 s <= high * p.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    bits = F.length(F.bin(F.size(vector))).cast("int")  # the length is below 2 ** bits
    most = F.get(F.array(*(F.lit(float(limit(1 << i))) for i in range(32))), F.least(bits, F.lit(31)))
    clamped = F.transform(F.col(vector), lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most)).cast("int"))
    whole = vectors.where(F.col(key).isNotNull() & label.isNotNull() & whole_vectors(F.col(vector)))
    path = shared_path(spark, "vectors")
    stored = whole.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), clamped.alias("x"), anchors.alias("anchor"))
    kinds = "key long, label long, x array<int>, mean array<double>, spread array<double>"
    stored.select("key", "label", "x").mapInArrow(_summarised, kinds).write.parquet(path)
    rows = spark.read.parquet(path)
    queries, out = shared_path(spark, "anchors"), shared_path(spark, "negatives")
    asked = stored.where("anchor").select("key", "label", "x", F.monotonically_increasing_id().alias("rid"))
    n = asked.count()
    blocks = max(1, math.ceil(n / block))
    asked.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(blocks))).write.partitionBy("part").parquet(queries)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], names).write.parquet(out)
    for part in range(blocks if n else 0):
        _one_block(rows, spark.read.parquet(queries).where(F.col("part") == part), positives, keep, low, high).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _one_block(rows: DataFrame, asked: DataFrame, positives: int, keep: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    found = asked.select("key", "label", "x").orderBy("key", "label", "x").collect()
    groups: dict[int, list] = {}
    for r in found:
        groups.setdefault(len(r["x"]), []).append(r)

    def made(rs: list, same: bool, least: np.ndarray, most: np.ndarray) -> Anchors:
        x = np.array([r["x"] for r in rs], np.int64).reshape(len(rs), -1)
        return Anchors(np.array([r["key"] for r in rs], np.int64), np.array([r["label"] for r in rs], np.int64), x, same, least, most)

    every = {d: made(rs, True, np.full((len(rs), 1), -(1 << 62)), np.full((len(rs), 1), 1 << 62)) for d, rs in groups.items()}
    near: dict[tuple[int, int], list] = {}
    for r in sorted(_ranked(rows, every, positives).collect(), key=lambda r: r["rank"]):
        near.setdefault((r["dims"], r["anchor"]), []).append((r["key"], r["score"]))
    windows, pairs = {}, []
    for d, rs in groups.items():
        least, most = np.full((len(rs), positives), 1 << 62), np.full((len(rs), positives), -(1 << 62))
        for i, r in enumerate(rs):
            have = near.get((d, i), [])
            least[i, : len(have)], most[i, : len(have)] = _windows([s for _, s in have], low, high)
            pairs += [(d, i, w, r["key"], k, s) for w, (k, s) in enumerate(have)]
        windows[d] = made(rs, False, least, most)
    about = F.broadcast(spark.createDataFrame(pairs, "dims int, anchor int, win int, anchor_id long, positive_id long, positive_score long"))
    picked = _ranked(rows, windows, keep).join(about, ["dims", "anchor", "win"])
    return picked.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label=moved)


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select anchor_id, positive_id, id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
