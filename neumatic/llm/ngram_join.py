"""Exact Jaccard join of word n-gram sets with set-relation skipping.

Candidates come from inverted lists over each set's prefix (its smallest
hashes; two sets of the wanted similarity share a hash of both prefixes). A
list is ordered by set size and cut into size blocks; only sets of the same or
the next block can be similar, all others are skipped. No list is turned into
pairs: each member is assigned to the first member of its own and of the
previous block, so the rows made are linear in the list. Members of one
assignment form a group, and every similar pair meets in some group. The
prefixes are longer than one common hash needs, by `extra` percent of the set:
similar sets then share many prefix hashes, and a set that shares too few with
sets of fitting sizes is left out before any set is moved.

Inside a group the sets are matched exactly: local rare-first prefixes with
lists ordered by size (runs of too small sets are skipped by position), sets
already known to be in one component skip each other, and the overlaps of a
set are derived from those of a highly similar set by adding and subtracting
the lists of the few differing n-grams. A group emits the links that span its
components. In groups over `group_rows` sets those like the first set are linked
to it beforehand, and only the others are compared in pairs of blocks.
Hashes are counted first: lists of more than `heavy_rows` members (a shingle in
every document) are not brought into one task; their members look up the first
of their size block in a table that is aggregated before the shuffle.

Words are runs of non-white-space bytes with A-Z lower-cased. Defined results:
fewer than `width` words make one n-gram of the whole sequence; null, empty or
blank texts have empty sets and link with nothing; equal sets are one class;
keys are whole numbers; rows without a key keep a null component; rows that
repeat a key are one node; columns other than key and text are not read; an
empty table gives an empty result. A long text is held whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import beside, kept, small_batches
from ._text import mix, slices, spark_long, windows, word_hashes, words
from .components import components


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes sorted within each row, offsets) of the distinct n-grams."""
    for first, end, data, offsets in slices(column):
        start, stop, row = words(data, offsets)
        value, row, _ = windows(word_hashes(data, start, stop), row, width)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        yield first, end, value, np.r_[0, np.cumsum(np.bincount(row, minlength=end - first))]


def least_overlap(n: np.ndarray | int, percent: int):
    """Smallest intersection that a set of n n-grams can have with a similar one."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """key, n and two 64-bit signatures of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            for first, end, value, offsets in sets_of(batch.column("text"), width):
                n[first:end] = np.diff(offsets)
                for out, v in ((one, value), (two, mix(value ^ np.uint64(0x2545F4914F6CDD1D)))):
                    total = np.r_[np.uint64(0), np.cumsum(v, dtype=np.uint64)]
                    out[first:end] = total[offsets[1:]] - total[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(spark_long(one)), pa.array(spark_long(two))], ["key", "n", "one", "two"])

    return docs.mapInArrow(run, "key long, n long, one long, two long")


def prefix_share(n: np.ndarray, extra: int):
    """How many hashes of both prefixes two similar sets have in common at least, by the smaller set's size."""
    return 1 + n * extra // 100


def _prefixes(batch: pa.RecordBatch, width: int, percent: int, extra: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, set sizes, prefix lengths, prefix hashes) of row ranges; equal sets that lie together come once."""
    keys = batch.column("key").to_numpy()
    for first, end, value, offsets in sets_of(batch.column("text"), width):
        n = np.diff(offsets)
        # of equal sets only the one of the smallest key is sent: the smallest of all always is
        total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        sums = total[offsets[1:]] - total[offsets[:-1]]
        by = np.lexsort((keys[first:end], n, sums))
        n[by[1:][(np.diff(n[by]) == 0) & (sums[by][1:] == sums[by][:-1])]] = 0
        take = np.where(n > 0, np.minimum(n, n - least_overlap(n, percent) + prefix_share(n, extra)), 0)
        at = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(take)[:-1]], take) + np.arange(take.sum())
        yield first, end, n, take, value[at]


def postings(docs: DataFrame, width: int, percent: int, extra: int) -> DataFrame:
    """(hash, size, key) of every prefix n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, n, take, hashes in _prefixes(batch, width, percent, extra):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(spark_long(hashes)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), pa.array(n.astype(np.int32)), lists], ["key", "n", "h"])

    found = docs.where("key is not null").mapInArrow(run, "key long, n int, h array<long>")
    return found.select(F.explode("h").alias("h"), "n", "key")


def frequent(docs: DataFrame, width: int, percent: int, extra: int, rows: int, fold: int = 1 << 20) -> DataFrame:
    """h: prefix hashes of more than `rows` sets.

    A task counts `fold` hashes at a time (some thousand sets) and sends those
    that it met twice or more, so that the many rare ones are never moved. What
    is missed lies in less than one set of each fold, and its list is short for
    the number of sets; either way of listing gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > 1
            return pa.RecordBatch.from_arrays([pa.array(spark_long(h[often])), pa.array(c[often])], ["h", "c"])

        for batch in batches:
            for *_, hashes in _prefixes(batch, width, percent, extra):
                held.append(hashes)
                size += len(hashes)
                if size >= fold:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    met = docs.where("key is not null").select("key", "text").mapInArrow(run, "h long, c long")
    return met.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > rows).select("h")


def assignments(lists: DataFrame, percent: int) -> DataFrame:
    """(key, group, shared, hits): list members assigned to the first of their size block and of the block before.

    `hits` counts the hashes by which a key is in a group; the sum of `shared`
    over a key counts its hashes that a set of the same or a neighbouring size
    block also has.
    """
    ratio = np.log(100 / percent + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64),) * 3
        counted = np.empty(0, bool)  # of the held list heads: already counted as shared
        for batch in batches:
            h, n, key = (batch.column(i).to_numpy() for i in range(3))
            block = np.floor(np.log(n) / ratio).astype(np.int64)
            own = len(held[0])
            h, block, key = (np.concatenate(x) for x in zip(held, (h, block, key)))
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])])
            size = np.diff(np.r_[starts, len(h)])
            seg = np.repeat(np.arange(len(starts)), size)
            head = key[starts]
            chained = np.r_[False, (h[starts][1:] == h[starts][:-1]) & (block[starts][1:] == block[starts][:-1] + 1)]
            before = np.r_[head[:1], head[:-1]]
            fresh = np.arange(len(h)) >= own
            inner = fresh & (np.arange(len(h)) != starts[seg])
            lower = fresh & chained[seg]
            # a head is shared once its list has a second member or a next block
            done = np.zeros(len(starts), bool)
            done[: len(counted)] = counted
            lead = (size > 1) | chained | np.r_[chained[1:], False]
            lead_now = lead & ~done
            alone = lower & ~inner & (np.arange(len(h)) != starts[seg])
            member = np.concatenate([key[inner], head[seg[inner]], key[lower], before[seg[lower]], head[lead_now]])
            group = np.concatenate([head[seg[inner]], head[seg[inner]], before[seg[lower]], before[seg[lower]], head[lead_now]])
            shared = np.concatenate([np.ones(inner.sum(), np.int64), np.zeros(inner.sum(), np.int64), alone[lower].astype(np.int64), np.zeros(lower.sum(), np.int64), np.ones(lead_now.sum(), np.int64)])
            if len(member):
                # a token may bring the same pair twice (as its own head and for a later member); such rows add no hit
                hit = np.concatenate([np.ones(inner.sum(), np.int64), np.zeros(inner.sum(), np.int64), np.ones(lower.sum(), np.int64), np.zeros(lower.sum(), np.int64), np.ones(lead_now.sum(), np.int64)])
                order = np.lexsort((member, group))
                member, group, shared, hit = member[order], group[order], shared[order], hit[order]
                new = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (group[1:] != group[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(member[new]), pa.array(group[new]), pa.array(np.add.reduceat(shared, new)), pa.array(np.add.reduceat(hit, new))], ["key", "group", "shared", "hits"])
            count = 2 if len(starts) > 1 and chained[-1] else 1
            held = (h[starts[-count:]], block[starts[-count:]], key[starts[-count:]])
            counted = (done | lead)[-count:]

    spread = lists.repartition("h").sortWithinPartitions("h", "n", "key")
    return spread.mapInArrow(run, "key long, group long, shared long, hits long")


def heavy_assignments(lists: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """The same rows as assignments() for the hashes of `often`, whose lists are too long for one task.

    The first member of each size block comes from an aggregation that is
    combined before the shuffle; the members only look it up.
    """
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent + 1e-9)))
    mine = kept(beside(lists, often.select("h"), "h").withColumn("block", block))
    w = Window.partitionBy("h").orderBy("block")
    heads = mine.groupBy("h", "block").agg(F.min(F.struct("n", "key")).alias("first"), F.count("*").alias("size"))
    near = lambda c, step: F.col("block") + step == c
    heads = heads.select("h", "block", F.col("first.key").alias("head"), "size", F.when(near(F.lag("block").over(w), -1), F.lag("first.key").over(w)).alias("before"), F.coalesce(near(F.lead("block").over(w), 1), F.lit(False)).alias("after"))
    placed = beside(mine, heads, ["h", "block"])
    shared = (F.col("size") > 1) | F.col("before").isNotNull() | F.col("after")
    groups = F.array_distinct(F.array_compact(F.array(F.when(shared, F.col("head")), F.col("before"))))
    # the head of the block before is in the group that it names
    out = placed.where(shared).select("key", F.posexplode(groups).alias("at", "group")).select("key", "group", (F.col("at") == 0).cast("long").alias("shared"), F.lit(1).cast("long").alias("hits"))
    return out


def all_assignments(docs: DataFrame, *, width: int, percent: int, extra: int, heavy_rows: int) -> DataFrame:
    """assignments() of the short lists and heavy_assignments() of the others, added up per key and group."""
    lists = postings(docs, width, percent, extra)
    often = kept(frequent(docs, width, percent, extra, heavy_rows))
    short = assignments(beside(lists, often, "h", "left_anti"), percent)
    found = short.unionAll(heavy_assignments(lists, often, percent))
    return found.groupBy("key", "group").agg(F.sum("shared").alias("shared"), F.sum("hits").alias("hits"))


def _gather(first: np.ndarray, length: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = length.sum()
    return values[np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)]


def match(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (larger set, smaller set) that span the components of the sets' similarity graph."""
    size = np.array([len(s) for s in sets])
    order = np.lexsort((keys, size))
    keys, size, sets = keys[order], size[order], [sets[i] for i in order]
    m = len(sets)
    token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(m), size)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    by = np.lexsort((rank[token], owner))
    place = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    probe = (place < (size - least_overlap(size, percent) + 1)[owner]) & (df[token[by]] > 1)
    if not probe.any():
        return []
    shared = df[token] > 1
    full = np.argsort(token[shared], kind="stable")
    full_owner = owner[shared][full]
    full_first, full_len = np.zeros(len(df), np.int64), np.bincount(token[shared], minlength=len(df))
    full_first[1:] = np.cumsum(full_len)[:-1]
    p_token, p_owner = token[by][probe], owner[probe]
    back = np.argsort(p_token, kind="stable")
    list_owner = p_owner[back]
    list_len = np.bincount(p_token, minlength=len(df))
    list_first = np.r_[0, np.cumsum(list_len)[:-1]]
    p_at = np.r_[0, np.cumsum(np.bincount(p_owner, minlength=m))]
    own_tokens = np.split(token, np.cumsum(size)[:-1])
    root = np.arange(m)
    links, last, counts = [], -1, None

    def tally(tokens: np.ndarray) -> np.ndarray:
        tokens = tokens[df[tokens] > 1]
        return np.bincount(_gather(full_first[tokens], full_len[tokens], full_owner), minlength=m)

    for x in range(m):
        probes = p_token[p_at[x] : p_at[x + 1]]
        if not len(probes):
            continue
        near = _gather(list_first[probes], list_len[probes], list_owner)
        # lists are ordered by size: what lies before `low` is too small, what lies after x asks later itself
        low = np.searchsorted(size, least_overlap(int(size[x]), percent))
        near = near[(near >= low) & (near < x)]
        near = near[root[near] != root[x]]
        if not len(near):
            continue
        mine = own_tokens[x]
        if last >= 0:
            gone, come = np.setdiff1d(own_tokens[last], mine, True), np.setdiff1d(mine, own_tokens[last], True)
        if last >= 0 and 2 * (len(gone) + len(come)) < len(mine):
            counts = counts + tally(come) - tally(gone)
        else:
            counts = tally(mine)
        last = x
        near = np.unique(near)
        both = counts[near]
        for y in near[100 * both >= percent * (size[x] + size[near] - both)]:
            if root[y] != root[x]:
                links.append((int(keys[x]), int(keys[y])))
                a, b = sorted((root[x], root[y]))
                root[root == b] = a
    return links


def _shipped(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, g, items): the sorted n-gram set of each wanted (key, g); every text is moved once, and its set made where it arrives."""
    listed = wanted.groupBy("key").agg(F.collect_list("g").alias("gs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, value, offsets in sets_of(batch.column("text"), width):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(spark_long(value)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), batch.column("gs").slice(first, end - first), lists], ["key", "gs", "items"])

    kind = listed.schema["gs"].dataType.simpleString()
    found = docs.where("key is not null").join(listed, "key").mapInArrow(run, f"key long, gs {kind}, items array<long>")
    return found.select("key", F.explode("gs").alias("g"), "items")


def head_links(docs: DataFrame, members: DataFrame, *, width: int, percent: int) -> DataFrame:
    """(key, group) of the members (key, group) that are similar to the first set of their group."""
    wanted = members.select("key", F.col("group").alias("g")).unionAll(members.select(F.col("group").alias("key"), F.col("group").alias("g"))).distinct()
    sets = kept(_shipped(docs, wanted, width).dropDuplicates(["key", "g"]))
    heads = sets.where("key = g").select("g", F.col("items").alias("head"))
    both = F.size(F.array_intersect("items", "head"))
    near = 100 * both >= percent * (F.size("items") + F.size("head") - both)
    return sets.where("key <> g").join(heads, "g").where(near).select("key", F.col("g").alias("group"))


def placed_members(docs: DataFrame, members: DataFrame, *, width: int, percent: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, g) of the comparisons that remain, and links found on the way.

    A group of at most `group_rows` sets is one comparison. In a larger one the
    sets are compared with its first set beforehand: those that are linked to
    it need no comparison among themselves, so only blocks of the others are
    paired, with each other and with blocks of the linked. A hot group of near
    copies, most of them like the first, is copied once or twice, whatever its size.
    """
    sizes = kept(members.groupBy("group").agg(F.count("*").alias("m")).where("m > 1"))
    small = members.join(sizes.where(F.col("m") <= group_rows), "group")
    large = members.join(sizes.where(F.col("m") > group_rows).select("group"), "group")
    linked = kept(head_links(docs, large.select("key", "group"), width=width, percent=percent))
    rest = large.select("key", "group").join(linked.withColumn("linked", F.lit(True)), ["key", "group"], "left").withColumn("linked", F.coalesce("linked", F.col("key") == F.col("group")))
    blocks = lambda of: F.ceil(F.count_if(of) / group_rows).cast("int")
    parts = rest.groupBy("group").agg(blocks(~F.col("linked")).alias("free"), blocks(F.col("linked")).alias("bound")).where("free > 0")
    mine = lambda n: F.pmod(F.xxhash64("key"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("linked"), F.col("free") + mine(F.col("bound"))).otherwise(mine(F.col("free")))
    last = F.when(F.col("linked"), F.col("free")).otherwise(F.col("free") + F.col("bound")) - 1
    rest = rest.join(parts, "group").select("key", "group", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    pairs = rest.select("key", F.struct("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("g"))
    whole = small.select("key", F.struct("group", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("g"))
    return whole.unionAll(pairs), linked.select(F.col("key").alias("a"), F.col("group").alias("b"))


def similar_links(docs: DataFrame, signed: DataFrame, *, width: int, percent: int, extra: int, group_rows: int, heavy_rows: int) -> DataFrame:
    """(a, b): links between different sets that span the components of the whole join."""
    lone = signed.where("n > 0 and key is not null").groupBy("one", "two", "n").agg(F.min("key").alias("key")).select("key", "n")
    members = kept(all_assignments(docs, width=width, percent=percent, extra=extra, heavy_rows=heavy_rows))
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * extra / 100)
    able = members.groupBy("key").agg(F.sum("shared").alias("shared")).join(lone, "key").where(F.col("shared") >= least).select("key", least.alias("least"))
    # two similar sets have `least` hashes in common; each may leave its thinnest groups as long as these hold less than half of them
    thinnest = Window.partitionBy("key").orderBy("hits", "group")
    members = members.join(able, "key").withColumn("so_far", F.sum("hits").over(thinnest)).where(2 * F.col("so_far") >= F.col("least")).select("key", "group")
    wanted, links = placed_members(docs, kept(members), width=width, percent=percent, group_rows=group_rows)

    def pair(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        items = table.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        flat, at = items.flatten().to_numpy(zero_copy_only=False), items.offsets.to_numpy()
        at = at - at[0]
        keys, first = np.unique(keys, return_index=True)
        found = match(keys, [flat[at[i] : at[i + 1]] for i in first], percent) if len(keys) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return _shipped(docs, wanted, width).groupBy("g").applyInArrow(pair, "a long, b long").unionAll(links)


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, extra: int = 15, group_rows: int = 4096, heavy_rows: int = 10_000) -> DataFrame:
    """key, n_shingles and component_id of every row.

    Two rows link when 100 * intersection >= percent * union of their sets;
    component_id is the smallest key reachable by links, the row's own included.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = kept(signatures(source, width))
    classes = signed.where("n > 0 and key is not null").groupBy("one", "two", "n").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    copies = signed.where("n > 0 and key is not null").join(classes.where("copies > 1"), ["one", "two", "n"]).where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    links = similar_links(source, signed, width=width, percent=percent, extra=extra, group_rows=group_rows, heavy_rows=heavy_rows).unionAll(copies)
    found = components(links)
    return signed.join(found, signed["key"] == found["id"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def one_per_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are the smallest key of their group (or have no key)."""
    others = join(docs, key=key, text=text, **options).where(F.col("component_id") != F.col(key)).select(key)
    return docs.join(others, key, "left_anti").select(*docs.columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
