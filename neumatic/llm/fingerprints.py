"""Document fingerprints by consistent weighted sampling.

The weighted terms of a text are its word pairs (A-Z lower-cased; a single
word is its own term), weighted by their counts. For each of `samples` samples
a term of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), fixed by term and
sample, and takes t = floor(ln w / r + b); the term with the least
ln c - r (t - b) - r wins and (term, t) is the sample. Two texts agree in a
sample with probability equal to their generalised Jaccard similarity
(sum of minima over sum of maxima), so the share of equal samples estimates it.

The draws come from a fixed table of 2**18 gamma and uniform triples that a
hash of term and sample picks from; equal picks are ordered by term.

Each text is also compared with its edited form and with the next text by key.
Neighbours are found without a global window: rows are cut at approximate key
quantiles into ranges, each range also gets the first row of the next one, and
is sorted and scanned by itself. Texts move once.

Defined results: null is the empty text, whose samples are all zero; equal
texts have equal fingerprints; rows without a key come last in the order, rows
of equal key follow by text; the row after the last is the first; a single row
is its own next row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from ._text import SLICE_BYTES, buffer_of, mix, windows, word_hashes, words

TABLE_BITS = 18


class Sampler:
    """Samples of weighted term sets, row by row."""

    def __init__(self, samples: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.once = self.log_c + self.r * self.b - self.r  # weight 1: t = 0
        self.keys = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def codes(self, term: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """[n_rows, samples] 16-bit codes; terms ordered by row and value, each once in a row."""
        out = np.zeros((n_rows, len(self.keys)), np.uint16)
        if not len(term):
            return out
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        lengths = np.diff(np.r_[starts, len(row)])
        many = np.flatnonzero(weight > 1)
        log_w = np.log(weight[many]).astype(np.float32)
        for k, key in enumerate(self.keys):
            at = ((term * key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            value = self.once[at]
            if len(many):
                m = at[many]
                t = np.floor(log_w / self.r[m] + self.b[m])
                value[many] = self.log_c[m] - self.r[m] * (t - self.b[m]) - self.r[m]
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(least, lengths))
            hit = hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]]
            level = np.zeros(len(hit), np.uint64)
            if len(many):
                where = np.searchsorted(many, hit)
                there = (where < len(many)) & (many[np.minimum(where, len(many) - 1)] == hit)
                level[there] = t[where[there]].astype(np.int64).view(np.uint64) + np.uint64(1)
                level[there & (weight[hit] > 1)] -= np.uint64(1)
            code = mix(term[hit] ^ mix(level + key)) >> np.uint64(48)
            out[row[hit], k] = np.maximum(code, np.uint64(1)).astype(np.uint16)
        return out


def terms(data: np.ndarray, offsets: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (hash, row, count), ordered by row and hash."""
    start, end, row = words(data, offsets)
    value, row, _ = windows(word_hashes(data, start, end), row, width)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])][: len(value)])
    return value[new], row[new], np.diff(np.r_[new, len(value)])


def _edited(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Edited text of every row but the last, and the code points of all rows."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    n = np.diff(first)
    lead = np.append(lead, len(data))
    raw, out = memoryview(data), []
    for i in range(len(n) - 1):
        half = int(n[i]) // 2
        cut = lead[first[i] + n[i] - half] if half else offsets[i + 1]
        stop = lead[first[i + 1] + half] if half < n[i + 1] else offsets[i + 2]
        out.append(bytes(raw[offsets[i] : cut]) + bytes(raw[offsets[i + 1] : stop]))
    return out, n


def _in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (key, text, tail) partitioned by range and sorted; each range ends with the first row of the next as tail.

    The order is by key (none last), then a hash of the text. Keys that fill
    several of the wanted ranges, and rows without a key, are cut by that hash.
    """
    hashed = docs.select("key", F.xxhash64("text").alias("h"), "text")
    found = docs.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000) if ranges > 1 else F.lit(None), F.count("*"), F.count("key")).first()
    cuts, times = np.unique(np.array(found[0] or [], np.int64), return_counts=True)
    # one range before each cut, for a key met twice or more as many of its own, and those without a key
    own = np.where(times > 1, times, 0)
    opens = np.r_[0, np.cumsum(1 + own)]
    last, unkeyed = int(opens[-1]) + 1, max(1, round(ranges * (found[1] - found[2]) / max(1, found[1])))

    def place(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        none = keys.is_null().to_numpy(zero_copy_only=False)
        key, high = keys.fill_null(0).to_numpy(zero_copy_only=False), (hashes.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        i = np.searchsorted(cuts, key)
        same = i < len(cuts)
        same[same] = cuts[i[same]] == key[same]
        part = lambda n: ((high * n.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        at = opens[i].copy()
        at[same] += 1 + part(np.r_[own, 0][i])[same]
        return pa.array(np.where(none, last + part(np.full(len(key), unkeyed)), at).astype(np.int32))

    bucket = F.arrow_udf(place, "int")(F.col("key"), F.col("h"))
    placed = hashed.withColumn("bucket", bucket)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h"))
    heads = placed.groupBy("bucket").agg(first.alias("f")).orderBy("bucket").collect()  # one small row per range
    if not heads:
        return docs.select("key", "text", F.lit(False).alias("tail"))
    following = docs.sparkSession.createDataFrame([(r["bucket"], r["f"]["key"], r["f"]["h"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)], "b int, k long, f long, target int")
    is_head = (F.col("bucket") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("f"))
    tails = placed.join(F.broadcast(following), is_head).groupBy("target", "key", "h").agg(F.min("text").alias("text"))  # as many rows as ranges
    rows = placed.withColumn("tail", F.lit(False)).unionAll(tails.select("key", "h", "text", F.col("target").alias("bucket"), F.lit(True)))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("key").asc_nulls_last(), "h", "text").select("key", "text", "tail")


def fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", samples: int = 64, width: int = 2) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _in_order(docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), 4 * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(samples), None

        def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            return sampler.codes(*terms(data, offsets, width), len(offsets) - 1)

        def hexes(codes: np.ndarray) -> list[str]:
            return [c.tobytes().hex() for c in codes.astype(">u2")]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            held = table.slice(len(table) - 1)
            texts, offsets = buffer_of(table.column("text"))
            tail = table.column("tail").to_numpy(zero_copy_only=False)
            first, n = 0, len(tail)
            while first < n - 1:
                last = max(first + 1, min(n - 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1))
                data, at = texts[offsets[first] : offsets[last + 1]], offsets[first : last + 2] - offsets[first]
                edited, chars = _edited(data, at)
                own = sketch(data, at)
                new = sketch(np.frombuffer(b"".join(edited), np.uint8), np.r_[0, np.cumsum([len(e) for e in edited])].astype(np.int64))
                keep = np.flatnonzero(~tail[first:last])
                near = (own[:-1] == new).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1)
                sha, mine, other = [hashlib.sha256(e).hexdigest() for e in edited], hexes(own[:-1]), hexes(new)
                yield pa.RecordBatch.from_arrays([
                    table.column("key").slice(first, last - first).combine_chunks().take(pa.array(keep)), pa.array(chars[:-1][keep].astype(np.int64)),
                    *(pa.array([x[i] for i in keep], pa.string()) for x in (sha, mine, other)), *(pa.array(x[keep]) for x in near),
                ], [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                first = last

    return rows.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
