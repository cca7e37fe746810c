"""Words that many texts have, found without moving the words of a text and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from .shared import computed


def counted(texts: DataFrame, least: int, also: Column) -> DataFrame:
    """word, n, lo, hi and unkeyed of the words that less than `least` keys of texts (doc_id, text) have, and of those for which `also` holds.

    n is the number of keys that have the word, of up to two the keys are lo and hi; unkeyed
    tells whether a text without a key has it. Texts of one key must be in one task.
    """
    words = F.array_distinct(F.flatten(F.transform(F.collect_list("text"), lambda t: F.split(t, F.lit(" "), F.lit(-1)))))
    each = texts.groupBy("doc_id").agg(words.alias("words")).select("doc_id", F.explode("words").alias("word"))
    n = each.groupBy("word").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bool_or(F.col("doc_id").isNull()).alias("unkeyed"))
    return computed(n.where((F.col("n") < least) | also))


@F.pandas_udf(ArrayType(BooleanType()))
def _among(texts: pd.Series, words: pd.Series) -> pd.Series:
    out = []
    for text, known in zip(texts, words):
        known = set(known)
        out.append(np.fromiter((w in known for w in text.split(" ")), bool))
    return pd.Series(out, dtype=object)


def with_rare(texts: DataFrame, words: DataFrame, tasks: int) -> DataFrame:
    """doc_id, pos, text and rare of each word of texts (doc_id, text), those of a doc_id in one of `tasks` tasks.

    `words` are those of counted() with least = 3 or less that count as rare. Each
    is brought to the few texts that have it; the words of texts are not moved.
    """
    keyed = F.when(F.col("n") > 0, F.array_distinct(F.array("lo", "hi"))).otherwise(F.array().cast(texts.select(F.array("doc_id")).schema[0].dataType))
    unkeyed = F.when(F.col("unkeyed"), F.array(F.lit(None).cast(texts.schema["doc_id"].dataType))).otherwise(F.array().cast(texts.select(F.array("doc_id")).schema[0].dataType))
    rare = words.select(F.explode(F.concat(keyed, unkeyed)).alias("doc_id"), F.lit(None).cast("string").alias("text"), "word")
    both = texts.select("doc_id", "text", F.lit(None).cast("string").alias("word")).unionAll(rare).repartition(tasks, "doc_id")
    held = both.groupBy("doc_id").agg(F.collect_list("text").alias("texts"), F.collect_list("word").alias("words")).select("doc_id", "words", F.explode("texts").alias("text"))
    marked = held.select("doc_id", F.split("text", " ", -1).alias("text"), _among("text", "words").alias("rare"))
    return marked.select("doc_id", F.posexplode(F.arrays_zip("text", "rare")).alias("pos", "w")).select("doc_id", F.col("pos").cast("long").alias("pos"), "w.text", "w.rare")
