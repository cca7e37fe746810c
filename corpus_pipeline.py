"""The corpus pipeline: language ID, near duplicates, benchmark leaks, secrets, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

* language_id: drops documents whose language the classifier rejects (texts
  without a letter, or below the calibrated score). It learns from the rows of
  its own input that are not held out.
* near_duplicates: keeps the smallest doc_id of each group of documents linked
  by 0.75 Jaccard similarity of five-word shingles.
* decontamination: drops documents that hold a benchmark item.
* secrets: replaces each secret in the text by a mark and sets n_chars anew
  (a null text stays null, with the n_chars it had); no document is dropped.
* segmentation: three sampled segmentations of each document, with their piece ids.

Nulls, empty texts, repeated rows and empty tables are treated as the five
operators' modules say; an empty table passes through every stage. Columns
that a caller's table has besides those of documents stay as they are up to
the last stage, also when a result of an operator has the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neumatic.llm import decontamination, language_id, ngram_join, sampling, secrets
from neumatic.llm._shared import shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised."""
    known = docs.where(~F.coalesce(language_id.held_out(), F.lit(True)))
    model = language_id.fit(known)
    return language_id.recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced."""
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three distinct segmentations of each document, sampled by document."""
    return sampling.sample(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("segmentation", segment),
]

#: SQL cannot express the trained classifier and the sampling; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
