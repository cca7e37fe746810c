"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

Every benchmark item is a weighted set of word shingles (five words,
lower-cased; a shorter item is one shingle of all its words) with a 256-bit
SimHash. A document's windows are as long as an item, in words. A window that
shares no shingle with an item has similarity 0 to it, and the best window for
an item can be shifted until it begins with one of the item's shingles, so
only windows that begin with a shingle of an item of their length are
fingerprinted; none that could reach the threshold is left out by that.

The fingerprints of the items are indexed by 32 blocks of 8 bits: for each
block and value the items within 2 bits. Two fingerprints within `radius` bits
have at most radius // 3 blocks that differ by 3 bits or more, so an item
within the radius is in the lists of at least 32 - radius // 3 blocks; only
such items are candidates. Unrelated items are in 4.6 lists on average, so
with the radius of 62 (12 lists) about 1 in 600 of them is a candidate. At
similarity 0.75 the expected distance is 44 bits with a deviation of 6.
Candidates within the radius are verified by the exact weighted Jaccard
similarity of their shingles.

Items are broadcast in blocks of about `block_items` items and `block_words`
words at most; an item of more words is a block of its own, of any length.
Each block is one more pass over the documents.

Defined results: null and empty texts hold no item; items without words match
nothing, items without an id are left out; repeated items and rows each give
their own result; all columns of the documents are kept whatever their names,
with `leaks` added (or replaced); empty tables give empty results or no leaks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, small_batches, unused
from ._text import mix, slices, windows, word_hashes, words

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.IntegerType())])
BLOCKS = 32
NEAR = 2
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


_SEEDS = (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)


def _spread(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes as 32 bytes each, along a new last axis."""
    return np.stack([mix(shingles ^ np.uint64(x)) for x in _SEEDS], axis=-1).view(np.uint8)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """[n, 256] signs (+1, -1) of 64-bit shingle hashes."""
    return np.unpackbits(_spread(shingles), axis=-1).astype(np.int8) * 2 - 1


def simhash(shingles: np.ndarray) -> np.ndarray:
    """[n, 32] bytes of the SimHash of each row of [n, m] shingles; repeated ones count again."""
    out = np.empty((len(shingles), BLOCKS), np.uint8)
    step = max(1, (1 << 22) // max(1, shingles.shape[1] * 256))
    for i in range(0, len(shingles), step):
        out[i : i + step] = np.packbits(_bits(shingles[i : i + step]).sum(axis=1, dtype=np.int32) > 0, axis=-1)
    return out


def window_prints(values: np.ndarray, begins: np.ndarray, m: int) -> np.ndarray:
    """simhash of values[b : b + m] for each b; overlapping or long windows by differences of running sums."""
    low, high = int(begins.min()), int(begins.max()) + m
    if m <= 1 << 12 and len(begins) * m <= 4 * (high - low):
        step = max(1, (1 << 20) // m)
        return np.concatenate([simhash(values[begins[i : i + step, None] + np.arange(m)]) for i in range(0, len(begins), step)])
    part, at = values[low:high], begins - low
    spread = _spread(part)
    out, total = np.empty((len(begins), BLOCKS), np.uint8), np.zeros((len(part) + 1, 8), np.int32)
    for b in range(BLOCKS):
        np.cumsum(np.unpackbits(spread[:, b : b + 1], axis=1).astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=total[1:])
        out[:, b] = np.packbits(total[at + m] - total[at] > 0, axis=1)[:, 0]
    return out


class ItemIndex:
    """Shingles, fingerprints and Hamming block lists of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], width: int, radius: int):
        self.width, self.radius = width, radius
        column = pa.array(texts, pa.string())
        self.ids, self.bags, self.size, prints = [], [], [], []
        for first, end, data, offsets in slices(column):
            start, stop, row = words(data, offsets)
            h = word_hashes(data, start, stop)
            value, owner, _ = windows(h, row, width)
            count = np.bincount(row, minlength=end - first)
            for i in range(end - first):
                if count[i] and ids[first + i] is not None:
                    mine = value[owner == i]
                    self.ids.append(ids[first + i])
                    self.bags.append(Counter(mine.tolist()))
                    self.size.append(int(count[i]))
                    prints.append(window_prints(mine, np.zeros(1, np.int64), len(mine))[0])
        self.prints = np.array(prints, np.uint8).reshape(-1, BLOCKS)
        self.size = np.array(self.size, np.int64)
        pairs = [(s, i) for i, bag in enumerate(self.bags) for s in bag]
        hashes = np.array([s for s, _ in pairs], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.shingle, self.owner = hashes[order], np.array([i for _, i in pairs], np.int64)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.shingle >> np.uint64(44)).astype(np.int64)] = True
        near = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= NEAR
        self.lists = [[np.flatnonzero(near[v, self.prints[:, b]]) for v in range(256)] for b in range(BLOCKS)] if len(self.ids) else []

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that are near in as many blocks as any pair within the radius is."""
        n, window, item = len(self.ids), [], []
        step = max(1, (1 << 22) // max(1, n))
        for first in range(0, len(prints), step):
            part = prints[first : first + step]
            places = [w * n + x for b in range(BLOCKS) for w, v in enumerate(part[:, b].tolist()) if len(x := self.lists[b][v])]
            votes = np.bincount(np.concatenate(places), minlength=len(part) * n) if places else np.zeros(len(part) * n, np.int64)
            w, i = np.divmod(np.flatnonzero(votes >= max(0, BLOCKS - self.radius // (NEAR + 1))), n)
            window.append(w + first)
            item.append(i)
        return np.concatenate(window), np.concatenate(item)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        window, item = self.candidates(prints)
        distance = _BITS[prints[window] ^ self.prints[item]].sum(axis=1)
        keep = distance <= self.radius
        return window[keep], item[keep], distance[keep]

    def search(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item id, similarity, first word, words, distance): the best window for each row and item over the threshold."""
        best: dict[tuple[int, int], tuple] = {}
        start, stop, row = words(data, offsets)
        if not len(row) or not len(self.ids):
            return []
        h = word_hashes(data, start, stop)
        row_first = np.searchsorted(row, np.arange(len(offsets) - 1))
        row_end = np.searchsorted(row, np.arange(len(offsets) - 1), "right")
        for width in sorted({min(self.width, int(n)) for n in self.size}):
            value, owner, first = windows(h, row, width, short=width == self.width)
            at = np.flatnonzero(self.sieve[(value >> np.uint64(44)).astype(np.int64)])
            if width < self.width:  # an item of few words is one shingle that also carries its length
                value = self._short(h, first, width)
                at = np.flatnonzero(self.sieve[(value >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(self.shingle, value[at]), np.searchsorted(self.shingle, value[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            hit = np.repeat(at, high - low)
            item = self.owner[np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())]
            if width < self.width:
                item_ok = self.size[item] == width
            else:
                item_ok = self.size[item] >= self.width
            hit, item = hit[item_ok], item[item_ok]
            r = owner[hit]
            n = np.minimum(self.size[item], row_end[r] - row_first[r])
            begin = np.minimum(first[hit], row_end[r] - n)
            todo = np.unique(np.stack([n, begin, r]), axis=1)
            for size in np.unique(todo[0]):
                begins, rows = todo[1:, todo[0] == size]
                m = max(1, int(size) - width + 1)
                index = np.searchsorted(first, begins)
                w, i, d = self.within(window_prints(value, index, m))
                for a, b, c in zip(w.tolist(), i.tolist(), d.tolist()):
                    mine, bag = Counter(value[index[a] : index[a] + m].tolist()), self.bags[b]
                    both = sum((mine & bag).values())
                    score = both / (sum(mine.values()) + sum(bag.values()) - both)
                    key = (int(rows[a]), self.ids[b])
                    if score >= threshold and (key not in best or (score, -begins[a]) > (best[key][0], -best[key][1])):
                        best[key] = (score, int(begins[a]), int(size), c)
        return [(r, i, s, b - int(row_first[r]), n, d) for (r, i), (s, b, n, d) in sorted(best.items())]

    def _short(self, h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        parts = h[first[:, None] + np.arange(width)].reshape(-1)
        rows = np.repeat(np.arange(len(first)), width)
        return windows(parts, rows, self.width)[0] if len(first) else np.empty(0, np.uint64)


def mark(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.75, radius: int = 62, block_items: int = 5_000, block_words: int = 2_000_000, into: str = "leaks") -> DataFrame:
    """docs with the column `into` added (one of that name gives way): the items that a window of the text matches, best window each.

    Items are taken in blocks of at most `block_items` items and `block_words`
    words (a longer item alone). With more than one block, the result of each
    is checkpointed before the next is read, so one block is held at a time.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rest = [f for f in docs.schema.fields if f.name != into]
    names, lowered = [f.name for f in rest], unused([*docs.columns, into], "lowered")
    rest = [*rest, T.StructField(lowered, T.StringType())]
    out = docs.select(*names, F.lower(text).alias(lowered), F.array().cast(T.ArrayType(LEAK)).alias(into))
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.lower(item_text).alias("t"))
    # a word takes two bytes with the space after it, so this is no less than the number of words
    n_words = F.coalesce(F.floor((F.octet_length("t") + 1) / 2), F.lit(0))
    sized = listed.select("*", n_words.alias("n"), F.xxhash64("i", "t").alias("h"))
    short = sized.where(F.col("n") <= block_words)
    n, total = short.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = max(-(-n // block_items), -(-total // block_words))
    blocks = [short.where(F.pmod("h", F.lit(passes)) == k) for k in range(passes)]
    blocks += [sized.where((F.col("n") > block_words) & (F.col("h") == r["h"])) for r in sized.where(F.col("n") > block_words).select("h").distinct().collect()]
    for b, block in enumerate(blocks):
        part = block.select("i", "t").orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(ItemIndex([r["i"] for r in part], [r["t"] or "" for r in part], width, radius))
        out = _pass(out, shared, threshold, rest, into)
        if b < len(blocks) - 1:
            out = kept(out)
            shared.destroy()
    return out.drop(lowered)


def _pass(docs: DataFrame, shared, threshold: float, rest: list, into: str) -> DataFrame:
    at = len(rest) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in slices(batch.column(at)):
                for r, *leak in index.search(data, offsets, threshold):
                    found[first + r].append(dict(zip(("item_id", "similarity", "first_word", "n_words", "distance"), leak)))
            if any(found):
                for have, more in zip(batch.column(len(rest)).to_pylist(), found):
                    more[:0] = have
                leaks = pa.array(found, batch.schema.field(len(rest)).type)
                batch = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), leaks], schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(into, T.ArrayType(LEAK))]))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    into = unused(docs.columns, "leaks")
    return mark(docs, items, into=into, **options).where(F.size(into) == 0).select(*docs.columns)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = mark(docs, items).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", F.col("leak.similarity").alias("similarity"), F.col("leak.first_word").alias("first_word"), F.col("leak.n_words").alias("n_words"), F.col("leak.distance").alias("distance"))
