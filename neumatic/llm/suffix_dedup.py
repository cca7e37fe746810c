"""Removal of repeated byte strings: ranks of thinned suffix positions.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Plain prefix doubling would sort a row per byte again and again, so the
positions are thinned first without loss: each window of `length` bytes is
represented by its anchor, the position of its smallest `gram`-byte hash.
Equal windows have equal anchors at equal offsets. The anchors are then ranked
as in prefix doubling, by growing lengths, and leave as soon as they are unique:

1. rank at `gram` bytes: anchors are counted by gram; those of a gram that is
   there once are done;
2. rank of the pair (gram, span), where the span reaches from the first to the
   last byte of all windows of an anchor (at least `length` bytes): equal pairs
   are past the threshold, so all their windows repeat;
3. anchors whose gram repeats but whose span differs (the edges of repeated
   strings) are ranked at `length` bytes, window by window, among the distinct
   contexts of their gram: in one group for up to `group_rows` contexts, else
   by a Spark aggregation of window hashes, which spreads a hot gram.

All counts are combined before the shuffle, and copies inside one slice of a
partition are folded, so a hot passage sends a row per slice and count, and
joins on it can be split.

Strings never cross rows. A row is known by a 64-bit hash of its key and text,
so keys of any type do, may repeat and may be null, with equal or different
texts. Hash equality (two independent 64-bit hashes combined) counts as
equality. Defined results: null and empty texts have 0 bytes; texts shorter
than `length` keep all; equal rows are occurrences of each other, whatever
their keys; an empty table gives an empty result; columns other than key and
text are not read. A long text is searched a megabyte at a time; its bytes are
held whole where it is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, small_batches
from ._text import SLICE_BYTES, Prefix, buffer_of, mix, powers, slices, spark_long

_BITS = 22  # of a position in a piece
_POSITION = np.uint64((1 << _BITS) - 1)


def _every(prefix: Prefix, size: int) -> np.ndarray:
    """prefix.span() of each run of `size` bytes; by slices, which is much cheaper than by places."""
    n = len(prefix.total) - size
    raw = prefix.total[size:] - prefix.total[:n]
    raw *= powers(prefix.inv, len(prefix.total))[:n]
    raw += np.uint64(size) * np.uint64(0xD6E8FEB86659FD93)
    return mix(raw)


def _both(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One 64-bit value from two independent hashes."""
    return mix(one ^ (two * np.uint64(0x9E3779B97F4A7C15)))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in it, bytes, offsets): row ranges of about a megabyte, or parts of one longer text that overlap by length - 1 bytes."""
    for first, end, data, offsets in slices(column):
        if len(data) <= 2 * SLICE_BYTES:
            yield first, 0, data, offsets
            continue
        for place in range(0, len(data) - length + 1, SLICE_BYTES):
            part = data[place : place + SLICE_BYTES + length - 1]
            yield first, place, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, spans: bool = True):
    """row, first and last window start, gram hash and (with `spans`) span hash of every anchor in a piece."""
    one = Prefix(data)
    grams = _every(one, gram)
    best = grams & ~_POSITION
    best |= np.arange(len(best), dtype=np.uint64)
    width, reach = 1, length - gram + 1
    while width * 2 <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < reach:
        best = np.minimum(best[: len(best) - (reach - width)], best[reach - width :])
    new = np.ones(len(best), bool)
    np.not_equal(best[1:], best[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(best)]] = True
    low = np.flatnonzero(new)
    high = np.r_[low[1:], len(best)] - 1
    # runs begin anew with each row, so only their ends can lie where no window of the row begins
    row = np.searchsorted(offsets, low, "right") - 1
    last = offsets[row + 1] - length
    keep = low <= last
    low, high, row = low[keep], np.minimum(high, last)[keep], row[keep]
    anchor = (best[low] & _POSITION).astype(np.int64)
    if not spans:
        return row, low, high, grams[anchor], None
    span = _both(one.span(low, high + length), Prefix(data, second=True).span(low, high + length))
    return row, low, high, grams[anchor], span + mix(((anchor - low) << 20 | (high - anchor + (1 << 19))).astype(np.uint64))


def _gram_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, n): grams of anchors with their number per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _pieces(batch.column("text"), length):
                if (np.diff(offsets) >= length).any():
                    g, n = np.unique(anchors(data, offsets, length, gram, spans=False)[3], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(spark_long(g)), pa.array(n.astype(np.int32))], ["g", "n"])

    return docs.where(F.octet_length("text") >= length).select("text").mapInArrow(run, "g long, n int")


def _anchor_rows(docs: DataFrame, length: int, gram: int, copies: bool) -> DataFrame:
    """(rid, low, high, g, span, n): the first anchor of each distinct span of a piece with the number of its copies there; or these further copies, without n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for first, place, data, offsets in _pieces(batch.column("text"), length):
                if not (np.diff(offsets) >= length).any():
                    continue
                row, low, high, g, span = anchors(data, offsets, length, gram)
                _, lead, inverse, count = np.unique(span, return_index=True, return_inverse=True, return_counts=True)
                take = np.zeros(len(span), bool)
                take[lead] = True
                if copies:
                    take = count[inverse] > 1
                base = offsets[row] - place
                columns = [rid[first + row[take]], (low - base)[take].astype(np.int32), (high - base)[take].astype(np.int32)]
                if not copies:
                    columns += [spark_long(g[take]), spark_long(span[take]), count[inverse][take].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "low", "high", "g", "span", "n"][: len(columns)])

    long_enough = docs.where(F.octet_length("text") >= length).select("rid", "text")
    return long_enough.mapInArrow(run, "rid long, low int, high int" if copies else "rid long, low int, high int, g long, span long, n int")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with each text compressed, for a shuffle by rid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress(memoryview(x.as_buffer()), 1) if x.is_valid else None for x in batch.column("text")], pa.binary())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", packed)

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields)


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """The bytes from the first to past the last window of each listed anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("g", pa.int64()), ("low", pa.int32()), ("done", pa.bool_()), ("large", pa.bool_()), ("context", pa.binary())])
        for batch in batches:
            out, size = [], 0
            for rid, packed, marks in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
                raw = zlib.decompress(packed.as_buffer())
                for m in marks:
                    part = raw[m["low"] : m["high"] + length]
                    out.append({"rid": rid, "g": m["g"], "low": m["low"], "done": m["done"], "large": m["large"], "context": part})
                    size += len(part)
                if size > 1 << 21:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return joined.select("rid", "text", "marks").mapInArrow(run, "rid long, g long, low int, done boolean, large boolean, context binary")


def _window_hashes(contexts: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, context index and window start of every window of the contexts."""
    data, offsets = buffer_of(contexts.column("context").cast(pa.large_binary()))
    every = _both(_every(Prefix(data), length), _every(Prefix(data, second=True), length))
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    return every[offsets[row] + place], row, place + contexts.column("low").to_numpy()[row]


def _runs(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first and last start of runs of consecutive starts (input ordered by key, start)."""
    if not len(key):
        return key, start, start
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(key)] - 1
    return key[new], start[new], start[last]


def repeats(docs: DataFrame, *, length: int = 200, gram: int = 100, group_rows: int = 1_000) -> DataFrame:
    """(rid, low, high): runs of window starts whose `length` bytes also start elsewhere; docs has rid and text."""
    # ranks at gram bytes: those that are there once need no further rank
    often = _gram_counts(docs, length, gram).groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    left = kept(_anchor_rows(docs, length, gram, False).join(often.hint("merge"), "g", "left_semi"))
    # ranks of the pair of gram and span
    spans = kept(left.groupBy("g", "span").agg(F.sum("n").alias("same"), F.min(F.struct("rid", "low", "high")).alias("first")))
    past = left.join(spans.where("same > 1").select("g", "span").hint("merge"), ["g", "span"], "left_semi").select("rid", "low", "high")
    past = past.unionAll(_anchor_rows(docs, length, gram, True))
    # edges: every distinct context of a gram that has several takes part in the ranking of windows
    kinds = spans.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mark = F.struct("g", "first.low", "first.high", (F.col("same") > 1).alias("done"), (F.col("kinds") > group_rows).alias("large"))
    wanted = spans.join(kinds.hint("merge"), "g").groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(mark).alias("marks"))
    contexts = kept(_contexts(_packed(docs.select("rid", "text")).join(wanted.hint("merge"), "rid"), length))

    def rerank(table: pa.Table) -> pa.Table:
        value, row, start = _window_hashes(table, length)
        done = table.column("done").to_numpy(zero_copy_only=False)
        _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
        hit = (count[inverse] > 1) & ~done[row]
        context, low, high = _runs(row[hit], start[hit])
        return pa.table({"rid": table.column("rid").to_numpy()[context], "low": low.astype(np.int32), "high": high.astype(np.int32)}, schema=pa.schema([("rid", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))

    edges = contexts.where("not large").groupBy("g").applyInArrow(rerank, "rid long, low int, high int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(0, len(table), 2048):
                part = table.slice(i, 2048)
                value, row, start = _window_hashes(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("rid").to_numpy()[row]), pa.array(start.astype(np.int32)), pa.array(part.column("done").to_numpy(zero_copy_only=False)[row]), pa.array(spark_long(value))], ["rid", "low", "done", "h"])

    hashed = contexts.where("large").mapInArrow(spread, "rid long, low int, done boolean, h long")
    again = hashed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    rest = hashed.where("not done").join(again.hint("merge"), "h", "left_semi").select("rid", "low", F.col("low").alias("high"))
    return past.unionAll(edges).unionAll(rest)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 100, group_rows: int = 1_000) -> DataFrame:
    """key, n_bytes, removed (array of start, end) and kept (the remaining bytes, concatenated) of every row."""
    small_batches(docs.sparkSession)
    if not 0 < gram <= length < SLICE_BYTES:
        raise ValueError("gram must be at most length, and length less than a megabyte")
    source = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("rid"), F.col(text).alias("text"))
    found = repeats(source, length=length, gram=gram, group_rows=group_rows)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            fields = lists.flatten()
            low, high = (fields.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.r_[0, np.cumsum([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])]
            size, removed, remains = [], [], []
            for i, packed in enumerate(batch.column("text")):
                body = zlib.decompress(packed.as_buffer()) if packed.is_valid else b""
                cuts = []
                if at[i + 1] > at[i]:
                    lo, hi = low[at[i] : at[i + 1]], high[at[i] : at[i + 1]] + length
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                    cuts = list(zip(lo[new].tolist(), hi[np.r_[new[1:], len(lo)] - 1].tolist()))
                ends = [0, *(b for _, b in cuts)]
                remains.append(b"".join(body[a:b] for a, b in zip(ends, [*(a for a, _ in cuts), len(body)])))
                removed.append([{"start": a, "end": b} for a, b in cuts])
                size.append(len(body))
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(size, pa.int64()), pa.array(removed, spans_type), pa.array(remains, pa.binary())], [key, "n_bytes", "removed", "kept"])

    joined = _packed(source).join(spans.hint("merge"), "rid", "left").select("key", "text", "spans")
    return joined.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
