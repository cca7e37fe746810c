"""Secret scans with DataFrame functions only: patterns plus a randomness test battery.

Three base patterns (assignments, access keys, hex strings) give the sure
spans. Beyond them, every run of 20 or more key-like characters outside the
base spans, or longer than the hex span it holds, is a candidate: its encoding is inferred from its characters (hex,
base32, letters and digits, base64), and a battery measures how it differs
from ordinary text of its length:

* chi-squared uniformity over the encoding's alphabet, against the mean and
  spread that ordinary text with collision probability `text_collision` shows,
* a runs test on changes between digits, lower and upper case,
* lag-1 serial correlation of character codes, which must stay within what
  independent draws give.

Both chi-squared and runs must speak against "ordinary text": the larger of
their p-values counts. Hex has a null of its own, joined words and numbers of
hex digits in any case: words of a to f repeat their few letters
(`hex_collision`, where uniform hex has 1/16) and change to a number and back
once in about six characters (`hex_change`, where uniform hex changes at 0.47). Neither test alone has power over 20 such characters, so their z-scores
are added (Stouffer). Benjamini-Hochberg at rate `fdr` then runs separately in each length
class. The p-values are rounded up to a fixed grid, so the ranks come from a
histogram of bounded size (length classes x grid) and not from a global sort.

Positions are code points, end exclusive. Defined results: null and empty
texts have no spans and zero counts; long texts are scanned whole; repeated
rows give repeated results; extra columns pass through, whatever their names;
an empty table gives an empty result. A text of n matches costs n * sqrt(n)
array copies at most, and runs are compared with base spans by binary search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import kept, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: encoding: (alphabet size, pattern), the first that matches is taken
ENCODINGS = (("hex", 16, r"^[0-9a-fA-F]+$"), ("base32", 32, r"^[A-Z2-7]+=*$"), ("alnum", 62, r"^[A-Za-z0-9]+$"), ("base64", 64, r"^[A-Za-z0-9+/_=-]+$"))
GRID = 64  # steps of -log10(p) per unit
TOP = 40  # largest -log10(p)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it, also inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, combine) -> Column:
    """For each element of an int array, `combine` (sum or greatest) of 0 and all elements before it.

    In blocks of about the square root of the size, as an array that grows by
    one is copied at each step; n elements cost n * sqrt(n) copies, not n * n.
    """

    def scanned(array: Column, value) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(array, zero, lambda acc, x: F.struct(combine(acc["total"], value(x)).alias("total"), F.concat(acc["starts"], F.array(acc["total"])).alias("starts")))

    def blocked(v: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))

        def with_size(k: Column) -> Column:
            count = F.ceil(F.size(v) / k).cast("int")
            inner = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: scanned(F.slice(v, b * k + 1, k), lambda x: x))
            return _let(inner, lambda blocks: F.flatten(F.zip_with(blocks, scanned(blocks, lambda b: b["total"])["starts"], lambda b, o: F.transform(b["starts"], lambda s: combine(s, o)))))

        return _let(size, with_size)

    return _let(values, blocked)


def _sum_before(values: Column) -> Column:
    return _before(values, lambda a, b: a + b)


def _max_before(values: Column) -> Column:
    return _before(values, lambda a, b: F.greatest(a, b))


def _at(text: Column, pattern: str) -> Column:
    """array<struct<match, start>>: the leftmost non-overlapping matches with code-point starts.

    split() gives what lies between the matches, so the running lengths of
    gaps and matches are the starts.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["gaps"], x["found"], lambda gap, m: F.coalesce(F.length(gap), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
        # the sum before a match and its own gap; there is one gap more than there are matches
        starts = F.zip_with(_sum_before(steps), x["gaps"], lambda s, gap: s + F.length(gap))
        return F.zip_with(x["found"], F.slice(starts, 1, F.size(x["found"])), lambda m, s: F.struct(m.alias("match"), s.alias("start")))

    return _let(F.struct(gaps.alias("gaps"), found.alias("found")), placed)


def _spans(text: Column, pattern: str, kind: int, least: int, tail: bool = False) -> Column:
    """array<struct<start, kind, end>> of the matches whose value has `least` characters."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = _at(text, pattern)
    value = (lambda m: F.regexp_extract(m, pattern, 2)) if tail else (lambda m: m)
    kept = F.filter(found, lambda x: F.length(value(x["match"])) >= least)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """Sorted array<struct<start, kind, end>>; kind 0 assign, 1 access, 2 hex."""
    # hex and access runs are maximal, so asking for the length in the pattern finds the same runs as filtering later
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, MIN_ASSIGN, tail=True),
        _spans(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1, MIN_ACCESS),
        _spans(text, f"[0-9a-f]{{{MIN_HEX},}}", 2, MIN_HEX),
    ))


KINDS = ("assign", "access", "hex", "random")


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _upper_tail(z: Column) -> Column:
    """-log10 of the normal upper tail, by a logistic approximation (error under 2e-4 for small z) and the Mills ratio beyond 4."""
    near = F.log10(1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))
    far = (z * z / 2 + F.log(z * math.sqrt(2 * math.pi))) / math.log(10)
    return F.when(z < 4, near).otherwise(far)


def battery(token: Column, *, text_collision: float = 0.06, text_change: float = 0.08, hex_collision: float = 0.11, hex_change: float = 0.32, serial_z: float = 3.5) -> Column:
    """struct<encoding, score>: -log10 of the p-value under ordinary text; 0 if the serial correlation is off."""
    n = F.length(token).cast("double")
    chars = F.split(token, "")
    size, name = F.lit(64.0), F.lit("base64")
    for enc, alphabet, pattern in reversed(ENCODINGS):
        size = F.when(token.rlike(pattern), F.lit(float(alphabet))).otherwise(size)
        name = F.when(token.rlike(pattern), F.lit(enc)).otherwise(name)
    is_hex = token.rlike(ENCODINGS[0][2])
    folded = F.when(is_hex, F.lower(token)).otherwise(token)
    collision = F.when(is_hex, hex_collision).otherwise(text_collision)
    change = F.when(is_hex, hex_change).otherwise(text_change)
    # bound once: what a lambda uses would else be computed again for each element
    squares = _let(folded, lambda f: F.aggregate(F.array_distinct(F.split(f, "")), F.lit(0.0), lambda a, c: a + F.pow((F.length(f) - F.length(F.replace(f, c, F.lit("")))).cast("double"), F.lit(2.0))))
    chi2 = size * squares / n - n
    # ordinary text: mean n(kc-1)+(k-1), spread of the pair count under collision probability c
    mean = (n - 1) * (size * collision - 1) + (size - 1)
    spread = size * F.sqrt(2 * (n - 1) / n * collision * (1 - collision))
    z_chi = (mean - chi2) / spread
    classes = F.translate(folded, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5)
    changes = n - F.length(F.regexp_replace(classes, r"(.)(?=\1)", ""))
    changes = (n - 1) - changes
    z_runs = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def serial(code: Column) -> Column:
        """Lag-1 correlation in deviations of what independent draws give."""
        products = F.struct(total(F.transform(code, lambda v: v * v)).alias("var"), total(F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: a * b)).alias("cov"))
        return _let(products, lambda p: F.when(p["var"] > 0, p["cov"] / p["var"] * F.sqrt(n)).otherwise(F.sqrt(n)))

    code = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    centred = _let(code, lambda v: _let(total(v) / n, lambda avg: F.transform(v, lambda c: c - avg)))
    z_serial = _let(centred, serial)
    z = F.when(is_hex, (z_chi + z_runs) / math.sqrt(2)).otherwise(F.least(z_chi, z_runs))
    score = F.when(F.abs(z_serial) <= serial_z, _upper_tail(z)).otherwise(0.0)
    return F.struct(name.alias("encoding"), F.least(F.greatest(score, F.lit(0.0)), F.lit(float(TOP))).alias("score"))


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double")) * 2), F.lit(24)).cast("int")


def _first_ending_after(spans: Column, at: Column) -> Column:
    """The first of sorted, disjoint spans whose end is beyond `at`, by binary search; null if there is none."""
    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        beyond, open_ = F.get(spans, middle)["end"] > at, acc["low"] < acc["high"]
        return F.struct(F.when(open_ & ~beyond, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & beyond, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve)["low"]
    return F.get(spans, place)


def _settled(base: Column, start: Column, end: Column) -> Column:
    """Whether a base span settles the run from start to end; a hex span inside a longer run does not."""
    touched = [F.coalesce(_first_ending_after(base[k], start)["start"] < end, F.lit(False)) for k in ("assign", "access")]
    return touched[0] | touched[1] | F.coalesce(_first_ending_after(base["hex"], end - 1)["start"] <= start, F.lit(False))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, kind, end, cls, bin>> of the key-like runs that no base span settles."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,cls:int,bin:int>>")
    # a run of one letter case without a digit is a word; it is no candidate
    mixed = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z].*[a-z].*[A-Z]"
    by_kind = F.struct(*[F.filter(base, lambda b, k=k: b["kind"] == k).alias(name) for k, name in enumerate(KINDS[:3])])
    found = F.filter(_at(text, CANDIDATE), lambda x: x["match"].rlike(mixed))
    free = _let(by_kind, lambda b: F.filter(found, lambda x: ~_settled(b, x["start"], x["start"] + F.length(x["match"]))))
    made = F.transform(free, lambda x: F.struct(
        x["start"].alias("start"), F.lit(3).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"),
        _length_class(F.length(x["match"])).alias("cls"), F.floor(battery(x["match"])["score"] * GRID).cast("int").alias("bin")))
    return F.when(text.rlike(CANDIDATE), made).otherwise(none)


def thresholds(found: DataFrame, column: str, fdr: float) -> dict[int, int]:
    """Smallest accepted grid step per length class (Benjamini-Hochberg).

    At most 25 x (TOP * GRID + 1) histogram rows exist whatever the input, and
    at most 25 thresholds reach the driver.
    """
    hist = found.select(F.explode(column).alias("c")).groupBy(F.col("c.cls").alias("cls"), F.col("c.bin").alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = hist.select("cls", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    p = F.pow(F.lit(10.0), -F.col("bin") / GRID)
    ok = ranked.where(p * F.col("m") <= fdr * F.col("rank"))
    return {r["cls"]: r["bin"] for r in ok.groupBy("cls").agg(F.min("bin").alias("bin")).collect()}


def _all_spans(base: Column, found: Column, cut: dict[int, int]) -> Column:
    """The base spans and the candidates that reach the threshold of their class, sorted."""
    least = F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv]) if cut else F.create_map(F.lit(-1), F.lit(0))
    random = F.filter(found, lambda c: c["bin"] >= F.coalesce(least[c["cls"]], F.lit(1 << 30)))
    return F.array_sort(F.concat(base, F.transform(random, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))


def scan(docs: DataFrame, *, text: str = "text", fdr: float = 0.01) -> DataFrame:
    """docs without its text, with base_spans and spans (arrays of start, kind, end) added; columns of docs with these names give way to them.

    The per-row spans are small; checkpoint() keeps them, so that the texts are
    scanned once.
    """
    rest = [c for c in docs.columns if c not in (text, "base_spans", "spans")]
    value, cand = unused(rest, "value"), unused(rest, "candidates")
    based = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(value)).withColumn("base_spans", base_spans(F.col(value)))
    found = kept(based.select(*rest, "base_spans", candidates(F.col(value), F.col("base_spans")).alias(cand)))
    return found.select(*rest, "base_spans", _all_spans(F.col("base_spans"), F.col(cand), thresholds(found, cand, fdr)).alias("spans"))


BLOCK = 1 << 10


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by `mark`.

    Pieces are cut from blocks of BLOCK characters: to cut far into a string,
    Spark must walk it from its begin.
    """
    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.substring(part, a - first * BLOCK + 1, F.greatest(b - a, F.lit(0)))

    def cut(x: Column) -> Column:
        bounds = F.zip_with(x["spans"], _max_before(F.transform(x["spans"], lambda s: s["end"])), lambda s, before: F.struct(before.alias("a"), s["start"].alias("b")))
        fresh = F.filter(bounds, lambda r: r["b"] >= r["a"])
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        last = F.array(F.struct(end.alias("a"), F.length(text).alias("b")))
        return F.array_join(F.transform(F.concat(fresh, last), lambda r: piece(x["blocks"], r["a"], r["b"])), mark)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(spans.alias("spans"), blocks.alias("blocks")), cut)).otherwise(text)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]", fdr: float = 0.01) -> DataFrame:
    """docs with every span of its text replaced by `mark`; overlapping spans become one mark. All other columns stay.

    The thresholds come from a first scan; the second scan replaces in place,
    so no text is shuffled. Rows without spans stay as they are.
    """
    base, cand = unused(docs.columns, "base_spans"), unused(docs.columns, "candidates")
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn(base, base_spans(value)).withColumn(cand, candidates(value, F.col(base)))
    spans = unused(docs.columns, "spans")
    found = found.withColumn(spans, _all_spans(F.col(base), F.col(cand), thresholds(found, cand, fdr)))
    return found.withColumn(text, _without(F.col(text), F.col(spans), mark)).select(*docs.columns)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
