"""Queries over the roles of text lines, by band (tests compare them with plain versions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roles as ops
from ..operators.shared import computed
from ..registry import query
from . import core

KEYS = ["score_id", "page", "line"]


def banded(spark, sf_dir):
    """Words by line; lines lie above, between, below staffs and at the foot in turn; some short words are chords, some lines a mark."""
    t = core.tokens(spark, sf_dir, together=True).where(F.trim("text") != "")
    line, first = F.col("line"), F.col("pos") % 8 == 0
    marks = F.array(*[F.lit(x) for x in ("Andante", "Key", "Coda", "D.C.", "Kết", "Fine", "2.")])
    mark = F.get(marks, (F.floor(line / 4) % 7).cast("int"))
    chord = F.concat(F.upper(F.left(F.translate("text", "éèêçóíñüöä", "eeecoinuoa"), F.lit(1))), F.lit("m"))
    short = (line % 8 == 0) & (F.length("text") <= 5)
    t = t.withColumn("text", F.when((line % 12 >= 8) & first, mark).when(short, chord).otherwise(F.col("text"))).where(first | (line % 12 < 8))
    band = F.get(F.array(*[F.lit(b) for b in ("above", "between", "below", "foot")]), (line % 4).cast("int"))
    return t.select(*KEYS, "pos", "text", band.alias("band"))


@query("x9_band_roles")
def x9_roles(spark, sf_dir):
    return ops.line_roles(banded(spark, sf_dir), KEYS)


@query("q18_role_accuracy")
def q18_roles(spark, sf_dir):
    """Roles of lines whose every seventh word has lost its last letter and whose every ninth line is not read, against the whole lines."""
    w = banded(spark, sf_dir)
    read = w.where("line % 9 <> 4").withColumn("text", F.when(F.col("pos") % 7 == 0, F.expr("left(text, greatest(length(text) - 1, 1))")).otherwise(F.col("text")))

    def boxes(words, dx):
        y = 20.0 * (F.col("line") % 4)
        return ops.line_roles(words, KEYS).select("score_id", "page", F.col("line").alias("box_id"), F.lit(dx).alias("x1"), y.alias("y1"), (dx + 8.0 * F.length("text")).alias("x2"), (y + 12).alias("y2"), "role")

    # lines are asked for twice, for the pairs and for their roles
    return ops.role_accuracy(computed(boxes(w, 0.0)), computed(boxes(read, 2.0)), ["score_id", "page"])
