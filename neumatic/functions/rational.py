"""Exact fractions as struct<num:long,den:long>: reduced, the denominator positive; null for a denominator of 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(a: Column, b: Column, body) -> Column:
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: body(p["a"], p["b"]))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs, by Euclid; as many steps as the digits of the smaller can need."""

    def of(a: Column, b: Column) -> Column:
        start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        steps = F.sequence(F.lit(1), 5 * F.length(F.least(a, b).cast("string")) + 1)
        return F.aggregate(steps, start, lambda r, _: F.when(r["b"] == 0, r).otherwise(F.struct(r["b"].alias("a"), (r["a"] % F.when(r["b"] != 0, r["b"])).alias("b"))))["a"]

    return _pair(F.abs(a), F.abs(b), of)


def fraction(num: Column | int, den: Column | int = 1) -> Column:
    def reduced(n: Column, d: Column) -> Column:
        sign = F.when(d < 0, -1).otherwise(1)
        return F.when(d != 0, _let(gcd(n, d), lambda g: F.struct(F.call_function("div", sign * n, g).alias("num"), F.call_function("div", sign * d, g).alias("den"))))

    return _pair(_long(num), _long(den), reduced)


def add(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda a, b: fraction(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"]))


def minus(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda a, b: fraction(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"]))


def times(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda a, b: fraction(a["num"] * b["num"], a["den"] * b["den"]))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return _pair(a, b, lambda a, b: F.signum(a["num"] * b["den"] - b["num"] * a["den"]).cast("int"))


def total(fractions: Column) -> Column:
    """Sum of an array of fractions; 0 without any."""
    return F.aggregate(fractions, fraction(0), add)


def value(a: Column) -> Column:
    return a["num"] / a["den"]


def text(a: Column) -> Column:
    return F.concat(a["num"], F.lit("/"), a["den"])
