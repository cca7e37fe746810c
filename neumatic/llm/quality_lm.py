"""Quality classifier: an interpolated modified Kneser-Ney character model.

Counts of character n-grams in trusted text (labelled good and not toxic) are
gathered per language from every trusted row that is not held out, folded per
task before the shuffle. An n-gram is its code points, 21 bits each in two
longs (order 6 at most), so no symbol is left out and no two n-grams meet.

The n-grams that the documents hold ride along with count 0 through the same
levels: continuation counts, count-of-count discounts, context totals and the
interpolation with the lower order are aggregations, windows and joins on
(language, n-gram), so one run gives the probability of every n-gram that is
asked for. A document's log-probability is then a join of its n-grams with that
table, sharded by n-gram hash, and a sum per document.

Most positions of a text are common n-grams. The commonest (at most `head`,
chosen by count from a histogram) are broadcast and added up where the text is
read; all others go through the join. The result does not depend on `head`.

Every fifth trusted document (by hash of its key) is kept out of the counts,
because a model finds its own training text too easy. A document passes if its
perplexity is at most the `quantile` of those held-out ones of its language,
widened by `slack` for short texts by 1 + slack / sqrt(symbols). A language
with a model but no held-out row takes the quantile over all languages.

Defined results: null and empty texts have no symbols, null perplexity and do
not pass; a language (or null) without trusted text has null perplexity and
passes, as nothing is known against it; extra columns are not read, whatever
their names; a repeated row is scored as often as it is there, and counts as
often in training; long texts are read a megabyte at a time; empty tables give
empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import beside, kept, small_batches
from ._text import SLICE_BYTES, Table, distinct, mix, slices

ORDER = 5
SYMBOL = 21
_MASK = (1 << SYMBOL) - 1
GRAM = ["lang", "hi", "lo"]


def _pieces(column: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, hi, lo) of the n-gram that ends at each code point, begin-padded within its row; a long text comes in pieces."""
    for first, end, data, offsets in slices(column):
        lead = (data & 0xC0) != 0x80
        start = 0
        while True:
            stop = min(len(data), start + SLICE_BYTES) if end - first == 1 else len(data)
            while stop < len(data) and not lead[stop]:
                stop += 1
            low = start
            for _ in range(order - 1):
                low = max(0, low - 1)
                while low and not lead[low]:
                    low -= 1
            symbol = np.frombuffer(data[low:stop].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            at = np.r_[0, np.cumsum(lead[low:stop])]
            row = np.repeat(np.arange(end - first), np.diff(at[np.clip(offsets - low, 0, stop - low)]))
            hi, lo = np.zeros(len(symbol), np.int64), symbol.copy()
            for back in range(1, order):
                before = np.zeros(len(symbol), np.int64)
                before[back:] = np.where(row[back:] == row[:-back], symbol[:-back], 0)
                if back < 3:
                    lo |= before << SYMBOL * back
                else:
                    hi |= before << SYMBOL * (back - 3)
            seen = int(at[start - low])
            yield first, end, row[seen:], hi[seen:], lo[seen:]
            if stop >= len(data):
                break
            start = stop


def _hash(lang: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(lo.view(np.uint64) ^ mix(hi.view(np.uint64) ^ mix(lang)))


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) << 32 | zlib.adler32(lang.encode()))


class _Langs:
    """Number and hash of each language met in a task; null is -1."""

    def __init__(self):
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        for x in set(column.to_pylist()) - {None} - self.number.keys():
            self.number[x] = len(self.names)
            self.names.append(x)
        return np.array([-1 if x is None else self.number[x] for x in column.to_pylist()], np.int64)

    def hashes(self) -> np.ndarray:
        return np.array([_lang_hash(x) for x in self.names] or [0], np.uint64)


def _folded(parts: list[tuple]) -> list[np.ndarray]:
    """lang, hi, lo and summed count of the distinct n-grams, ordered so that they compress well."""
    lang, hi, lo, c = (np.concatenate(x) for x in zip(*parts))
    first, inverse = distinct(_hash(lang.astype(np.uint64), hi, lo))
    total = np.bincount(inverse, weights=c, minlength=len(first)).astype(np.int64)
    order = np.lexsort((lo[first], hi[first]))
    return [x[first][order] for x in (lang, hi, lo)] + [total[order]]


def gram_counts(docs: DataFrame, order: int, known=None) -> DataFrame:
    """(lang, hi, lo, c) rows of n-gram counts, folded per task; with `known` (a broadcast of hashes) only other n-grams, with count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, parts, size = _Langs(), [], 0
        table = None if known is None else Table(known.value, np.zeros(len(known.value), np.int8))

        def flush(held: list) -> pa.RecordBatch:
            lang, hi, lo, c = _folded(held)
            names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(langs.names, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(hi), pa.array(lo), pa.array(c)], [*GRAM, "c"])

        for batch in batches:
            of = langs.of(batch.column("lang"))
            hashes = langs.hashes()
            for first, end, row, hi, lo in _pieces(batch.column("text"), order):
                lang = of[first:end][row]
                if (lang < 0).any():
                    lang, hi, lo = lang[lang >= 0], hi[lang >= 0], lo[lang >= 0]
                if not len(lang):
                    continue
                lead, inverse = distinct(_hash(hashes[lang], hi, lo))
                c = np.bincount(inverse, minlength=len(lead))
                if table is not None:
                    lead = lead[~table.get(_hash(hashes[lang[lead]], hi[lead], lo[lead]))[0]]
                    c = np.zeros(len(lead), np.int64)
                parts.append((lang[lead], hi[lead], lo[lead], c))
                size += len(lead)
                if size > 1 << 20:
                    folded = _folded(parts)
                    parts, size = [tuple(folded)], len(folded[0])
                    if size > 1 << 19:
                        yield flush(parts)
                        parts, size = [], 0
        if size:
            yield flush(parts)

    return docs.select("lang", "text").mapInArrow(run, "lang string, hi long, lo long, c long")


def _suffix(o: int) -> list[Column]:
    """hi and lo of the last o symbols."""
    keep = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << SYMBOL * n) - 1))
    return [(keep("hi", o - 3) if o > 3 else F.lit(0).cast("long")).alias("hi"), keep("lo", min(o, 3)).alias("lo")]


def _context() -> list[Column]:
    """hi and lo of all symbols but the last."""
    moved = F.shiftleft(F.col("hi").bitwiseAND(F.lit(_MASK)), SYMBOL * 2)
    return [F.shiftrightunsigned("hi", SYMBOL).alias("xh"), F.shiftrightunsigned("lo", SYMBOL).bitwiseOR(moved).alias("xl")]


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 (for counts 1, 2, and more) and the number of seen n-grams: a row per language."""
    n = {i: F.col(f"n{i}") for i in range(1, 5)}
    counted = level.where("c > 0").groupBy("lang").agg(F.count("*").alias("size"), *[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in n])
    y = n[1] / (n[1] + 2 * n[2])
    fitted = lambda i: F.when((n[i] > 0) & (n[1] > 0), F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * n[i + 1] / n[i]))).otherwise(i / 2)
    return counted.select("lang", "size", *[fitted(i).alias(f"d{i}") for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, hi, lo, c, p) of every n-gram of counts (lang, hi, lo, c), those of count 0 included.

    Lower orders count in how many longer n-grams of count 1 or more they are
    the end. Order 1 is interpolated with 1 / (distinct symbols + 1), so that
    the seen symbols and one unseen symbol sum to 1. Contexts never seen pass
    the lower order on unchanged. N-grams of languages without any count are
    left out.
    """
    levels = {order: kept(counts.groupBy(*GRAM).agg(F.sum("c").alias("c")))}
    for o in range(order - 1, 0, -1):
        shorter = levels[o + 1].select("lang", *_suffix(o), (F.col("c") > 0).cast("long").alias("one"))
        levels[o] = kept(shorter.groupBy(*GRAM).agg(F.sum("one").alias("c")))
    lower = None
    for o in range(1, order + 1):
        w = Window.partitionBy("lang", "xh", "xl")
        many = lambda n: F.sum((n & (F.col("c") > 0)).cast("double")).over(w)
        level = levels[o].select(*GRAM, "c", *_context()).withColumns({
            "total": F.sum("c").over(w).cast("double"), "m1": many(F.col("c") == 1), "m2": many(F.col("c") == 2), "m3": many(F.col("c") > 2)})
        level = beside(level, _discounts(levels[o]), "lang")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.greatest(F.lit(0.0), F.col("c") - d) / F.col("total")
        gamma = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        seen = F.col("total") > 0
        level = level.select(*GRAM, "c", "size", F.when(seen, own).otherwise(0.0).alias("own"), F.when(seen, gamma).otherwise(1.0).alias("gamma"))
        if lower is None:
            p = level.select(*GRAM, "c", (F.col("own") + F.col("gamma") / (F.col("size") + 1)).alias("p"))
        else:
            th, tl = _suffix(o - 1)
            below = lower.select("lang", F.col("hi").alias("th"), F.col("lo").alias("tl"), F.col("p").alias("below"))
            p = level.select(*GRAM, "c", "own", "gamma", th.alias("th"), tl.alias("tl")).join(below, ["lang", "th", "tl"])
            p = p.select(*GRAM, "c", (F.col("own") + F.col("gamma") * F.col("below")).alias("p"))
        lower = kept(p)
    return lower


def _head(counts: DataFrame, head: int) -> int:
    """The smallest count of which all n-grams together are at most `head`, from a histogram of at most 600 steps."""
    step = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2("c") * 8) + 16)
    rows = counts.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in rows:
        total += r["n"]
        if total > head:
            break
        least = r["c"]
    return least


def score(docs: DataFrame, training: DataFrame, *, order: int = ORDER, head: int = 1 << 19) -> DataFrame:
    """(key, lang, n, log_p) of every row; docs has key, lang and text, training has lang and text. log_p is null for languages without training text."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    spark = docs.sparkSession
    counts = kept(gram_counts(training, order).groupBy(*GRAM).agg(F.sum("c").alias("c")))
    least = _head(counts, head)

    def common(frame: DataFrame, *columns: str) -> tuple[np.ndarray, pa.Table]:
        rows = frame.where(F.col("c") >= least).select(*GRAM, *columns).toArrow()
        langs = rows.column("lang").to_pylist()
        number = {x: _lang_hash(x) for x in set(langs)}
        hi, lo = (rows.column(c).to_numpy() for c in ("hi", "lo"))
        return _hash(np.array([number[x] for x in langs], np.uint64), hi, lo), rows

    asked = gram_counts(docs.where("text is not null and lang is not null"), order, spark.sparkContext.broadcast(common(counts)[0]))
    model = kneser_ney(counts.unionAll(asked), order)
    keys, rows = common(model, "p")
    shared = spark.sparkContext.broadcast((keys, np.log(rows.column("p").to_numpy()).astype(np.float32)))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = _Langs(), Table(*shared.value)
        for batch in batches:
            of, ident = langs.of(batch.column("lang")), batch.column("ident").to_numpy()
            hashes, many = langs.hashes(), batch.num_rows
            n, sure, rest = np.zeros(many, np.int64), np.zeros(many), []
            for first, end, row, hi, lo in _pieces(batch.column("text"), order):
                n[first:end] += np.bincount(row, minlength=end - first)
                mine = of[first:end][row] >= 0
                row, hi, lo = row[mine] + first, hi[mine], lo[mine]
                found, value = table.get(_hash(hashes[of[row]], hi, lo))
                sure += np.bincount(row[found], weights=value[found], minlength=many)
                row, hi, lo = row[~found], hi[~found], lo[~found]
                if len(row):
                    lead, inverse = distinct(_hash(row.astype(np.uint64), hi, lo))
                    rest.append((row[lead], hi[lead], lo[lead], np.bincount(inverse, minlength=len(lead))))
            # one row for the document itself, whose n-gram is none (spread by its hash), and one for each n-gram still to look up
            row, hi, lo, times = (np.concatenate(x) for x in zip((np.arange(many), np.full(many, -1), ident, np.zeros(many, np.int64)), *rest))
            own = np.arange(len(row)) < many
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(row, mask=~own)), pa.array(ident[row]), batch.column("lang").take(pa.array(row)), pa.array(hi), pa.array(lo), pa.array(times.astype(np.int32)),
                pa.array(np.where(own, n[row], 0)), pa.array(np.where(own, sure[row], 0.0)), pa.array(own.astype(np.int32))], ["key", "ident", *GRAM, "times", "n", "sure", "copies"])

    source = docs.select("key", F.xxhash64("key", "text", "lang").alias("ident"), "lang", "text")
    parts = source.mapInArrow(run, f"key {kind}, ident long, lang string, hi long, lo long, times int, n long, sure double, copies int")
    valued = parts.join(model.select(*GRAM, F.log("p").alias("log_p")).hint("merge"), GRAM, "left")
    summed = valued.groupBy("ident", "lang").agg(
        F.max("key").alias("key"), F.sum("n").alias("n"), F.sum("sure").alias("sure"), F.sum(F.col("times") * F.col("log_p")).alias("looked_up"),
        F.sum((F.col("times") > 0).cast("long")).alias("asked"), F.count("log_p").alias("answered"), F.sum("copies").alias("copies"))
    # copies of a row have one ident: their sums are shared out again
    log_p = F.when((F.col("asked") == F.col("answered")) & (F.col("lang").isNotNull() | (F.col("n") == 0)), (F.col("sure") + F.coalesce("looked_up", F.lit(0.0))) / F.col("copies"))
    each = summed.select("key", "lang", (F.col("n") / F.col("copies")).cast("long").alias("n"), log_p.alias("log_p"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.drop("copy")


def _trusted_texts(source: DataFrame, trusted: DataFrame) -> DataFrame:
    """lang and text of the trusted rows; texts are compressed one by one for the shuffle. A merge join at every size: the keys grow with the data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([zlib.compress(memoryview(x.as_buffer()), 1) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), packed], ["key", "lang", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([zlib.decompress(x.as_buffer()) for x in batch.column("packed")], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), texts], ["lang", "text"])

    kind = source.schema["key"].dataType.simpleString()
    packed = source.where("text is not null and lang is not null").mapInArrow(pack, f"key {kind}, lang string, packed binary")
    return packed.join(trusted.hint("merge"), "key", "left_semi").select("lang", "packed").mapInArrow(unpack, "lang string, text string")


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = 0.999, slack: float = 3.0, head: int = 1 << 19) -> DataFrame:
    """key, lang, n_symbols, perplexity, limit and passed of every row of docs."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(key).alias("key")).distinct()
    held_out = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    scored = kept(score(source, _trusted_texts(source, trusted.where(~held_out)), order=order, head=head))
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))))
    widened = F.col("perplexity") / (1 + slack / F.sqrt(F.col("n").cast("double")))
    held = kept(scored.join(trusted.where(held_out).hint("merge"), "key", "left_semi").where("perplexity is not null").select("lang", widened.alias("v")))
    over_all = held.agg(F.percentile_approx("v", quantile, 10_000)).first()[0]
    judged = beside(scored, held.groupBy("lang").agg(F.percentile_approx("v", quantile, 10_000).alias("own")), "lang", "left")
    least = F.when(F.col("log_p").isNotNull(), F.coalesce("own", F.lit(over_all).cast("double")))
    limit = least * (1 + slack / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    passed = (F.col("n") > 0) & F.coalesce(F.col("perplexity") <= limit * (1 + 1e-9), F.lit(True))
    return judged.select(F.col("key").alias(key), "lang", F.col("n").alias("n_symbols"), "perplexity", limit.alias("limit"), passed.alias("passed"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classify(docs, labels)
