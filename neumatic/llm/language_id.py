"""Language ID: averaged hashed subword embeddings with a linear softmax.

A document is the mean of the embeddings of its hashed byte n-grams; a linear
softmax over that mean names the language. Both are trained in numpy by
stochastic gradient descent on a bounded, documented sample of labelled rows.
Temperature and rejection threshold are calibrated on a part of the sample
that the descent never sees.

Because the classifier is linear in the mean, embedding and softmax weights
fold into one score per n-gram bucket and language, so that scoring needs one
table look-up per n-gram: no shuffle, no state beyond a fixed table of
`buckets` x languages.

Defined results: null text, or text without a letter, is `und` with score 0
and is rejected. Columns that the caller's table has besides the named ones
pass through; columns called lang_pred, score or rejected give way to the
results. Repeated rows each get their own result; a long text is read piece by
piece, whole. An empty table gives an empty result. With no labelled row
there is no language to learn: all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import small_batches, unused
from ._text import LOWER, SLICE_BYTES, slices

NGRAMS = (2, 3, 4)


@dataclass(frozen=True)
class LanguageModel:
    """Folded scores [buckets, languages], bias, temperature and rejection threshold."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _normal(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and every ASCII non-letter as a space."""
    low = LOWER[data]
    ascii_other = (low < 128) & ~((low >= 97) & (low <= 122))
    low = low.copy()
    low[ascii_other] = 32
    return low


def _features(data: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the n-grams that hold at least one letter byte."""
    low = _normal(data).astype(np.uint32)
    solid = low != 32
    for n in NGRAMS:
        m = len(low) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        letters = np.zeros(m, np.uint8)
        for i in range(n):
            code = (code ^ low[i : m + i]) * np.uint32(0x01000193)
            letters += solid[i : m + i]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        keep = np.flatnonzero(letters * 2 > n)
        yield keep, (code[keep] % np.uint32(buckets)).astype(np.int64)


def train(texts: list[str], langs: list[str], *, buckets: int = 1 << 15, dim: int = 16, epochs: int = 6, rate: float = 0.5, reject_rate: float = 0.002, seed: int = 7) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent, then calibrate.

    Every fifth text is held back for calibration: the temperature minimises
    its log loss, and the threshold rejects `reject_rate` of its rows at most,
    and never a row whose calibrated score is 0.5 or more.
    """
    names = tuple(sorted(set(langs)))
    label = np.array([names.index(x) for x in langs])
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        found = [b for _, b in _features(data, buckets)]
        b, c = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
        rows.append((b, c / max(1, c.sum())))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    held = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~held)
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            b, w = rows[i]
            if not len(b):
                continue
            step = rate * (1 - steps / total) + 0.01
            steps += 1
            mean = w @ table[b]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * p
            # each embedding moves by its share; the mean-weighted step is scaled up to stay useful for long texts
            table[b] -= step * np.outer(np.minimum(1.0, w * len(b)), back)
    folded = table @ out
    check = np.flatnonzero(held) if held.any() else fit
    logits = np.array([rows[i][1] @ folded[rows[i][0]] + bias for i in check]) if len(check) else np.zeros((0, len(names)))

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label[check]]))

    grid = np.geomspace(0.25, 20, 41)
    temperature = float(min(grid, key=loss)) if len(logits) else 1.0
    z = logits / temperature
    score = (np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)).max(axis=1) if len(logits) else np.ones(1)
    return LanguageModel(names, folded.astype(np.float32), bias.astype(np.float32), temperature, float(min(0.5, np.quantile(score, reject_rate))))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 250, max_bytes: int = 20_000, **options) -> LanguageModel | None:
    """Train on at most `per_lang` labelled rows of each language.

    The sample is the rows whose key hashes lowest, of texts of at most
    `max_bytes` bytes; it is bounded by `per_lang` x `max_bytes` x languages.
    Returns None if no row is labelled.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.octet_length(text) <= max_bytes))
    order = Window.partitionBy("lang").orderBy("h", "k")
    keys = labelled.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"))
    chosen = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("k").toPandas()["k"].tolist()
    if not chosen:
        return None
    sample = labelled.where(F.col(key).isin(chosen)).select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = sample.orderBy("h", "k", "lang", "text").limit(len(chosen)).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def predict(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", keep: list[str] | None = None, into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs (or its columns `keep`) with the language, its score and whether it is rejected added as `into`."""
    keep = docs.columns if keep is None else keep
    clash = set(into) & set(keep)
    keep = [c for c in keep if c not in clash]
    if model is None:
        return docs.select(*keep, F.lit("und").alias(into[0]), F.lit(0.0).alias(into[1]), F.lit(True).alias(into[2]))
    small_batches(docs.sparkSession)
    taken = [*docs.columns, *into]
    body, lettered = unused(taken, "body"), unused(taken, "lettered")
    source = docs.select(*keep, F.col(text).alias(body), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(lettered))
    out = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType()), T.StructField(into[2], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        k, buckets = len(m.langs), len(m.table)
        for batch in batches:
            sums, counts = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows)
            for first, end, data, offsets in slices(batch.column(body)):
                row_of = np.repeat(np.arange(end - first, dtype=np.int32), np.diff(offsets))
                for piece in range(0, max(1, len(data)), SLICE_BYTES):  # a very long text goes piece by piece
                    part = data[piece : piece + SLICE_BYTES + max(NGRAMS) - 1]
                    for n, (at, b) in zip((n for n in NGRAMS if len(part) >= n), _features(part, buckets)):
                        own = at < SLICE_BYTES
                        at, b = at[own] + piece, b[own]
                        row = row_of[at]
                        whole = row == row_of[at + (n - 1)]
                        row, b = row[whole], b[whole]
                        counts[first:end] += np.bincount(row, minlength=end - first)
                        for j in range(k):
                            sums[first:end, j] += np.bincount(row, weights=m.table[b, j], minlength=end - first)
            z = (sums / np.maximum(counts, 1)[:, None] + m.bias) / m.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            letters = batch.column(lettered).to_numpy(zero_copy_only=False)
            value = np.where(letters, p[np.arange(len(best)), best], 0.0)
            named = np.where(letters, np.array(m.langs, dtype=object)[best], "und")
            arrays, names = batch.columns[: len(keep)], batch.schema.names[: len(keep)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(named, pa.string()), pa.array(value), pa.array(~letters | (value < m.reject_below))], [*names, *into])

    return source.mapInArrow(score, out)


def recognised(docs: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """The rows of docs whose language is not rejected, with their columns."""
    into = tuple(unused(docs.columns, name) for name in ("lang_pred", "score", "rejected"))
    return predict(docs, model, text=text, into=into).where(~F.col(into[2])).select(*docs.columns)


def held_out(key: str = "doc_id"):
    """The rows that training must not see: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", **options) -> DataFrame:
    """Train on the rows of `docs` that are not held out and predict every row."""
    known = docs.where(~F.coalesce(held_out(key), F.lit(True)))
    model = fit(known, text=text, lang=lang, key=key, **options)
    return predict(docs, model, text=text)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
    return found
