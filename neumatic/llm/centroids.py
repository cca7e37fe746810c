"""Centroid clustering: Lloyd's algorithm sharded by dimension, in exact integers.

The vectors are written once, as integers, with one column for each block of
`width` components. A round is a union with one branch for each block: its
tasks scan only their column, hold only their slice of the centroids, and give
for each vector the exact partial distances to all centroids, beside the
vector's own slice. The sum by vector adds the blocks and takes the nearest
centroid; the slices then go on to sums by (block, centroid), combined before
the shuffle, from which each block gets its new slice. So one shuffle carries a
round, no task holds whole centroids or a whole cluster, and hot clusters are
summed map-side. The driver sees k x dimensions numbers a round. Each round
starts from the written table, so lineage doesn't grow.

Defined results: only vectors with exactly `dims` components, none null or
non-finite, take part; other rows are left out. A component x becomes
floor(scale * x), held to +-LIMIT(dims), so that distances fit in a long. Rows
that repeat a key are vectors of their own (and seeds of their own, ties by
vector); a null key takes part but is no seed. With fewer vectors than k there
are as many centroids; an empty table gives an empty result. Other columns of
the caller's table are not returned; result columns that clash with the key
give way (`distance_`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept, shared_path, unused


def limit(dims: int) -> int:
    """The largest component whose squared differences, `dims` of them, fit in a long."""
    return math.isqrt((1 << 60) // max(1, dims))


def whole_vectors(vector: Column, dims: int | None = None) -> Column:
    """True for vectors without null or non-finite components (and of `dims` components, if given)."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.coalesce(finite if dims is None else (F.size(vector) == dims) & finite, F.lit(False))


def integers(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component, held to +-most."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-most))), F.lit(float(most)))).cast("int"))


@dataclass(frozen=True)
class Sharded:
    """The written vectors: (rid, key, x0, x1, ...), x_b the b-th block of components."""

    rows: DataFrame
    starts: tuple[int, ...]
    width: int


def shard(vectors: DataFrame, *, key: str, vector: str, dims: int, scale: int, width: int) -> Sharded:
    spark = vectors.sparkSession
    whole = vectors.where(whole_vectors(F.col(vector), dims)).select(F.col(key).alias("key"), integers(F.col(vector), scale, limit(dims)).alias("x"))
    starts = tuple(range(0, dims, width))
    cut = [F.slice("x", s + 1, min(width, dims - s)).alias(f"x{b}") for b, s in enumerate(starts)]
    path = shared_path(spark, "vectors")
    whole.select(F.monotonically_increasing_id().alias("rid"), "key", *cut).write.parquet(path)
    return Sharded(spark.read.parquet(path), starts, width)


def seeds(table: Sharded, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose key has the smallest hash, in its order."""
    parts = [f"x{b}" for b in range(len(table.starts))]
    hashed = F.sha2(F.concat(F.lit(prefix), F.col("key").cast("string")), 256)
    rows = table.rows.where("key is not null").select(hashed.alias("h"), *parts).orderBy("h", *parts).limit(k).collect()
    return np.array([sum((list(r[p]) for p in parts), []) for r in rows], dtype=np.int64)


def _partial(slice_: np.ndarray, block: int, carried: bool):
    """Arrow batches of (rid, x_b) to the partial distances to each centroid of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = slice_.shape
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            top = max(int(np.abs(x).max(initial=0)), int(np.abs(slice_).max(initial=0)))
            if 4 * width * top * top < 1 << 53:  # exact in doubles
                f, c = x.astype(np.float64), slice_.astype(np.float64)
                d = ((f * f).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
            else:
                d = np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in slice_], axis=1)
            own = [pa.array(np.full(len(x), block, np.int32)), column] if carried else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, *(pa.array(np.ascontiguousarray(d[:, i])) for i in range(k))], names=["rid", *["block", "part"][: len(own)], *(f"d{i}" for i in range(k))])

    return run


def nearest(table: Sharded, centroids: np.ndarray, carried: bool) -> DataFrame:
    """(rid, distance, cluster) of each vector, with its slices as `parts` if carried."""
    k = len(centroids)
    kind = "rid long, " + ("block int, part array<int>, " if carried else "") + ", ".join(f"d{i} long" for i in range(k))
    branches = [
        table.rows.select("rid", f"x{b}").mapInArrow(_partial(centroids[:, s : s + table.width], b, carried), kind)
        for b, s in enumerate(table.starts)
    ]
    parts = [F.collect_list(F.struct("block", "part")).alias("parts")] if carried else []
    summed = reduce(DataFrame.unionAll, branches).groupBy("rid").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(k)), *parts)
    all_ = F.array(*(f"d{i}" for i in range(k)))
    near = summed.select("rid", F.array_min(all_).alias("distance"), all_.alias("all"), *["parts"][: len(parts)])
    return near.withColumn("cluster", (F.array_position("all", F.col("distance")) - 1).cast("int")).drop("all")


def moved(table: Sharded, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each block's floored means; a centroid without vectors stays."""
    slices = nearest(table, centroids, carried=True).select("cluster", F.explode("parts").alias("p")).select("cluster", "p.block", "p.part")
    total = [F.sum(F.get("part", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(table.width)]
    means = slices.groupBy("block", "cluster").agg(F.count("*").alias("n"), *total)
    new = centroids.copy()
    for r in means.select("block", "cluster", *((F.col(f"s{j}") - F.pmod(F.col(f"s{j}"), F.col("n"))).alias(f"s{j}") for j in range(table.width)), "n").collect():
        s = table.starts[r["block"]]
        part = [r[f"s{j}"] // r["n"] for j in range(table.width) if r[f"s{j}"] is not None]
        new[r["cluster"], s : s + len(part)] = part
    return new


def cluster(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3,
    scale: int = 64, prefix: str = "1:", width: int = 32,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of each vector after `rounds` rounds, and the centroids."""
    names = [unused([key], n) for n in ("cluster", "distance")]
    table = shard(vectors, key=key, vector=vector, dims=dims, scale=scale, width=width)
    centroids = seeds(table, k, prefix)
    if not len(centroids):
        nothing = table.rows.where("false").select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.toDF(key, *names), centroids.reshape(0, dims)
    for _ in range(rounds):
        centroids = moved(table, centroids)
    ends = nearest(table, centroids, carried=False)
    return kept(ends.join(table.rows.select("rid", "key"), "rid").select("key", "cluster", "distance")).toDF(key, *names), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` of cluster() with cluster_inertia, inertia and the hash of its centroid; sums beyond a long stop there."""
    spark, most = found.sparkSession, (1 << 63) - 1
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(most, sum(sums.values()))
    rows = [(c, min(most, s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(k: int, rounds: int) -> str:
    """The same clustering in SQL, one row for each component."""
    text = f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
comps as (select rid, unnest(x) as x, unnest(range(64)) as j from kept),
seeds as (select rid, row_number() over (order by sha256('1:' || vec_id), x) - 1 as c from kept where vec_id is not null
  qualify row_number() over (order by sha256('1:' || vec_id), x) <= {k}),
c0 as (select c, j, x from seeds join comps using (rid))"""
    for i in range(rounds + 1):
        text += f""",
d{i} as (select rid, c, sum((a.x - b.x) * (a.x - b.x)) as d from comps a join c{i} b using (j) group by all),
a{i} as (select rid, c, d from d{i} qualify row_number() over (partition by rid order by d, c) = 1)"""
        if i < rounds:
            text += f""",
m{i} as (select c, j, cast(floor(sum(x) / count(*)) as bigint) as x from a{i} join comps using (rid) group by all),
c{i + 1} as (select c, j, coalesce(m.x, o.x) as x from c{i} o left join m{i} m using (c, j))"""
    return text + f"""
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, h.s as centroid_sha256
from a{rounds} join kept using (rid) join (select c, sha256(string_agg(cast(x as varchar), ',' order by j)) as s from c{rounds} group by c) h using (c)"""


OP11_SQL = _rounds_sql(16, 3)
