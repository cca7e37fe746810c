"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns give the sure spans (email, ip, card, phone); they stay. The
field looks at what they leave: it reads a window of text as a sequence of
segments, each either one token of ordinary text or one entity of at most
MAX_TOKENS tokens. Features are of the whole span (number of digits, lengths
of its groups, separators, check digit, four parts up to 255, forms of "at"
and "dot", its neighbours), with a weight for each type; transitions have
weights too. Forward-backward gives the likelihood for training and the
posterior of a segment; Viterbi over segments chooses boundaries and types
together. A chosen segment becomes a span if its posterior is `least` or more.

The field is trained by stochastic gradient descent on windows around base
spans, at most `per_kind` of each kind and of windows without one, those whose
text hashes lowest (a bounded sample, the only part of the corpus that the
driver sees). There are no labels beyond the base patterns, so each sampled
span is also rewritten by rule into a form that they miss (national phone
numbers, spelled-out "at" and "dot", dotted cards), and damaged by rule (wrong
check digit, parts over 255, too few digits) into one that must be left alone.
A corpus without base spans trains nothing and adds no span.

Segments must look possible (CANDIDATE, WRITTEN) and miss all base spans.
Everywhere else the best path is ordinary text, so only windows around
possible segments are decoded, which gives the same result as whole texts.
Texts are read once: a small table of spans and windows is checkpointed, then
sampled and decoded.

Positions are code points, end exclusive. Defined results: null and empty
texts have no spans; long texts are read whole; repeated rows give repeated
results; extra columns pass through, whatever their names (base_spans and
spans give way to the results); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept, small_batches, unused

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MAX_TOKENS = 24
CONTEXT = 40
SPAN = "array<struct<kind:int,start:int,end:int>>"
FOUND = f"struct<base:{SPAN},windows:array<struct<start:int,text:string,spans:{SPAN},open:boolean>>>"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")

#: runs of numbers that may hold a span
CANDIDATE = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ()+./\[\]-]{0,3}[0-9]){3,}(?![A-Za-z0-9])")
#: "at" in the middle of a written address, and what may follow it
WRITTEN = re.compile(r"(?: ?@ ?| ?[(\[]at[)\]] ?| at )", re.I)
_AFTER = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| \. | ?[(\[](?:dot|\.)[)\]] ?| dot )[A-Za-z0-9-]{1,63}){1,6}", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; linear in the text, also where regex search would try every start of a long run."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((EMAIL, start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            spans.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            spans.append((PHONE, m.start(), m.end()))
    return spans


def _possible(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of a text (without its base spans) that may hold a segment."""
    for m in CANDIDATE.finditer(text):
        yield m.start(), m.end()
    for m in WRITTEN.finditer(text):
        before, after = _BEFORE.search(text, max(0, m.start() - 64), m.start()), _AFTER.match(text, m.end())
        if before and after and ("@" in m[0] or " dot " in after[0].lower() or "(" in m[0] or "[" in m[0] or "." in after[0]):
            yield before.start(), after.end()


def _merged(ranges: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """Ranges that meet, joined; the flag is true if it is for any of them."""
    out: list[tuple[int, int, bool]] = []
    for a, b, flag in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), flag or out[-1][2])
        else:
            out.append((a, b, flag))
    return out


def find(text: str) -> dict:
    """Base spans of a text, and the windows around them and around what may be a segment (`open`)."""
    base = base_spans(text)
    pieces, at = [], 0
    for a, b, _ in _merged([(s, e, False) for _, s, e in base]):
        pieces += [text[at:a], "\0" * (b - a)]
        at = b
    rest = "".join([*pieces, text[at:]]) if pieces else text
    ranges = [(s, e, False) for _, s, e in base] + [(s, e, True) for s, e in _possible(rest)]
    spans = lambda a, b: [{"kind": k, "start": s - a, "end": e - a} for k, s, e in base if a <= s and e <= b]
    windows = _merged([(max(0, s - CONTEXT), min(len(text), e + CONTEXT), flag) for s, e, flag in ranges])
    return {"base": [{"kind": k, "start": s, "end": e} for k, s, e in base], "windows": [{"start": a, "text": text[a:b], "spans": spans(a, b) if base else [], "open": flag} for a, b, flag in windows]}


def _near(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "space" if c.isspace() else "letter" if c.isalnum() else c


def features(text: str, start: int, end: int) -> list[str] | None:
    """Features of a whole span, or None if it can't be an entity."""
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits, low = sum(map(len, groups)), s.lower()
    around = [f"left={_near(text, start - 1)}", f"right={_near(text, end)}"]
    if any("a" <= c <= "z" for c in low):
        at = "@" if "@" in s else "(at)" if "(at)" in low or "[at]" in low else " at " if " at " in low else ""
        word, dots = len(re.findall(r" dot |[(\[]dot[)\]]", low)), s.count(".")
        if not at or not (word or dots) or not s[0].isalnum() or not s[-1].isalpha() or len(s) > 200:
            return None
        local, _, domain = low.partition(at)
        domain_at = len(local) + len(at)
        labels = re.split(r" ?[(\[](?:dot|\.)[)\]] ?| dot | ?\. ?", domain.strip())
        plain = all(re.fullmatch("[a-z0-9-]+", x) for x in labels)
        if labels[-1] == "dot":
            return None
        return ["text", f"at={at}", f"word={min(word, 3)}", f"dots={min(dots, 4)}", f"labels={min(len(labels), 5)},{plain}", f"local={bool(re.fullmatch('[a-z0-9._%+-]+', local.strip()))},{' ' in local.strip()}",
                f"last={min(len(labels[-1]), 5)},{s[-1].islower()},{s[domain_at:].islower()}", f"spaced={' @' in s or '@ ' in s}", f"full={plain and len(labels) > 1}|{at}", *around]
    if not (4 <= digits <= 19) or len(s) > 60 or not s[-1].isdigit() or not (s[0].isdigit() or s[0] in "+(") or (digits < 7 and len(groups) != 4):
        return None
    seps = "".join(sorted({c for c in s if not c.isdigit()}))
    quad = len(groups) == 4 and all(int(g) <= 255 for g in groups)
    card = digits >= 16 and luhn("".join(groups))
    shape = "-".join(str(min(len(g), 9)) for g in groups[-3:])
    form = _DIGITS.sub(lambda m: str(min(len(m[0]), 9)), s)
    return ["number", f"form={form}", f"digits={digits}", f"groups={min(len(groups), 6)}", f"shape={shape}", f"seps={seps}", f"first={s[0] if s[0] in '+(' else '00' if s.startswith('00') else '0'}",
            f"quad={quad},{seps}", f"card={card}" if digits >= 16 else "short", f"card={card}|{len(set(map(len, groups))) == 1}" if digits >= 16 else f"digits={digits}|{min(len(groups), 6)}|{s[0] if s[0] in '+(' else '0'}", f"open={s.count('(') == s.count(')')}", f"tight={'  ' in s}", *around]


def segments(text: str, closed: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Bounds of a window's pieces, and its possible segments (first piece, end piece, features), none of which touches a closed range."""
    bounds = [0, *(m.end() for m in _TOKEN.finditer(text))]
    solid = np.zeros(len(text) + 1, bool)
    for a, b in closed:
        solid[a:b] = True
    out = []
    rest = "".join("\0" if z else c for c, z in zip(text, solid)) if closed else text
    for a, b, _ in _merged([(a, b, True) for a, b in _possible(rest)]):
        first, last = int(np.searchsorted(bounds, a)), int(np.searchsorted(bounds, b))
        for i in range(first, last):
            if text[bounds[i]].isspace():
                continue
            for j in range(i + 1, min(i + MAX_TOKENS, last) + 1):
                f = features(text, bounds[i], bounds[j])
                if f:
                    out.append((i, j, f))
    # tokens at whose bound no segment begins or ends belong to one piece of ordinary text
    active = sorted({0, len(bounds) - 1, *(i for i, _, _ in out), *(j for _, j, _ in out)})
    place = {b: p for p, b in enumerate(active)}
    return [bounds[b] for b in active], [(place[i], place[j], f) for i, j, f in out]


@dataclass
class Field:
    """Weights: feature -> one for each kind; transitions [from, to], 0 being ordinary text."""

    weights: dict[str, np.ndarray]
    turns: np.ndarray

    def scores(self, found: list) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for _, _, fs in found]).reshape(-1, len(KINDS))


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def _forward(n: int, found: list, score: np.ndarray, turns: np.ndarray, join) -> tuple[np.ndarray, np.ndarray]:
    """(ends, reach): weight of all paths that end a segment of a type at a token bound, and that are about to begin one there."""
    ends, reach = np.full((n + 1, len(turns)), -np.inf), np.full((n + 1, len(turns)), -np.inf)
    ends[0, 0] = 0
    by_end: dict[int, list[int]] = {}
    for c, (_, j, _) in enumerate(found):
        by_end.setdefault(j, []).append(c)
    for p in range(n + 1):
        if p:
            ends[p, 0] = reach[p - 1, 0]
            if p in by_end:
                cs = by_end[p]
                ends[p, 1:] = join(reach[[found[c][0] for c in cs], 1:] + score[cs], 0)
        reach[p] = join(ends[p][:, None] + turns, 0)
    return ends, reach


def _backward(n: int, found: list, score: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rest, ahead): weight of all ways on after a segment of a type, and of those that begin one at a bound."""
    rest, ahead = np.zeros((n + 1, len(turns))), np.full((n + 1, len(turns)), -np.inf)
    by_start: dict[int, list[int]] = {}
    for c, (i, _, _) in enumerate(found):
        by_start.setdefault(i, []).append(c)
    for p in range(n - 1, -1, -1):
        ahead[p, 0] = rest[p + 1, 0]
        if p in by_start:
            cs = by_start[p]
            ahead[p, 1:] = _sum(rest[[found[c][1] for c in cs], 1:] + score[cs], 0)
        rest[p] = _sum(turns + ahead[p], 1)
    return rest, ahead


def posteriors(field: Field, n: int, found: list) -> tuple[np.ndarray, np.ndarray, float]:
    """([segment, kind], transitions expected, log of the sum over all paths)."""
    score = field.scores(found)
    ends, reach = _forward(n, found, score, field.turns, _sum)
    rest, ahead = _backward(n, found, score, field.turns)
    z = float(_sum(ends[n], 0))
    i, j = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
    each = np.exp(reach[i, 1:] + score + rest[j, 1:] - z) if len(found) else score
    turns = np.exp(ends[:n, :, None] + field.turns + ahead[:n, None, :] - z).sum(axis=0)
    return each, turns, z


def best_path(field: Field, n: int, found: list) -> list[tuple[int, int]]:
    """(segment, kind) of the entities of the best path, in order."""
    score = field.scores(found)
    ends, reach = _forward(n, found, score, field.turns, lambda x, axis: x.max(axis=axis))
    by_end: dict[int, list[int]] = {}
    for c, (_, j, _) in enumerate(found):
        by_end.setdefault(j, []).append(c)
    path, p, kind = [], n, int(ends[n].argmax())
    while p:
        if kind:
            c = max(by_end[p], key=lambda c: reach[found[c][0], kind] + score[c, kind - 1])
            path.append((c, kind - 1))
            p, now = found[c][0], kind
        else:
            p, now = p - 1, 0
        kind = int((ends[p] + field.turns[:, now]).argmax())
    return path[::-1]


def _rewritten(kind: int, s: str, rng: np.random.Generator) -> tuple[str, str]:
    """A form of a span that the base patterns miss, and a damaged one that is none."""
    pick = lambda *x: x[rng.integers(len(x))]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    if kind == EMAIL:
        local, _, domain = s.partition("@")
        local, domain = pick(local, local, re.split("[.]", local)[0] or local), pick(domain, domain, ".".join(domain.split(".")[-2:]))
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", "."), (" @ ", " . "), (" at ", "."))
        return local + at + domain.replace(".", dot), pick(f"{local} at {domain.split('.')[0]}", f"{local} {domain.replace('.', ' ')}", f"{domain.replace('.', ' dot ')}", f"{local[:4]} at {domain.split('.')[0]}.{domain.split('.')[-1].capitalize()}")
    if kind == IP:
        return s.replace(".", pick("[.]", " . ", "(.)")), ".".join([*groups[:3], str(300 + int(groups[3]))])
    if kind == CARD:
        four, sep = [digits[i : i + 4] for i in range(0, len(digits), 4)], pick(".", " - ", "  ", "/", "")
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(9))) % 10)
        return sep.join(four), pick(wrong, sep.join(wrong[i : i + 4] for i in range(0, len(wrong), 4)))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    lengths = [int(n) for n in rng.integers(1, 7, rng.integers(3, 6))]
    many = (digits * 3)[: sum(lengths)]
    odd = pick("-", "-", " ", ".", ", ").join(many[sum(lengths[:i]) : sum(lengths[: i + 1])] for i in range(len(lengths)))
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10] or '1'} {a} {b} {c}", f"{a} {b} {c}", s), pick(f"{b}-{c}", f"{c}-{b[:2]}-{a[:2]}", digits + b + c[:2], f"{a}{b}", odd, odd, f"{c}-{c[::-1]}, {a}")


def examples(windows: list[tuple[str, list[tuple[int, int, int]]]], rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows without spans as they are; the others with their spans rewritten three times, and damaged twice (as they are, base patterns take them)."""
    out = [(text, spans) for text, spans in windows if not spans]
    for text, spans in windows:
        for good in (True, True, True, False, False) if spans else ():
            made, gold, at = "", [], 0
            for kind, s, e in sorted(spans, key=lambda x: x[1]):
                if s < at:
                    continue
                new, bad = _rewritten(kind, text[s:e], rng)
                made += text[at:s]
                if good:
                    gold.append((kind, len(made), len(made) + len(new)))
                made, at = made + (new if good else bad), e
            out.append((made + text[at:], gold))
    return out


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], *, epochs: int = 5, rate: float = 0.5, decay: float = 1e-3, seed: int = 12) -> Field | None:
    """The field of these windows (text, spans); None if there is no span. AdaGrad on the likelihood of the spans, deterministic."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, spans in examples(windows, rng):
        bounds, found = segments(text, [])
        place = {b: i for i, b in enumerate(bounds)}
        at = {(i, j): c for c, (i, j, _) in enumerate(found)}
        gold = [(at[place[s], place[e]], k, s) for k, s, e in spans if s in place and e in place and (place[s], place[e]) in at]
        if len(gold) == len(spans) and found:  # others are forms that no segment can have
            rows.append((len(bounds) - 1, found, sorted(gold, key=lambda g: g[2])))
    if not any(gold for _, _, gold in rows):
        return None
    width = len(KINDS) + 1
    field = Field({}, np.zeros((width, width)))
    seen: dict[str, np.ndarray] = {}
    turned = np.full((width, width), 1e-6)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            n, found, gold = rows[r]
            each, turns, _ = posteriors(field, n, found)
            slope, real = -each, -turns
            last, end = 0, 0
            for c, k, _ in gold:
                slope[c, k] += 1
                i, j, _ = found[c]
                if i > end:
                    real[last, 0] += 1
                    real[0, 0] += i - end - 1
                    last = 0
                real[last, k + 1] += 1
                last, end = k + 1, j
            if n > end:
                real[last, 0] += 1
                real[0, 0] += n - end - 1
            turned += real * real
            field.turns += rate * (real - decay * field.turns) / np.sqrt(turned)
            for c in np.flatnonzero(np.abs(slope).max(axis=1) > 1e-4):
                for f in found[c][2]:
                    w, g = field.weights.setdefault(f, np.zeros(len(KINDS))), seen.setdefault(f, np.full(len(KINDS), 1e-6))
                    g += slope[c] ** 2
                    w += rate * (slope[c] - decay * w) / np.sqrt(g)
    return field


def decode(field: Field, text: str, closed: list[tuple[int, int]], least: float) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the sure entities of the best path of a window."""
    bounds, found = segments(text, closed)
    if not found:
        return []
    each, _, _ = posteriors(field, len(bounds) - 1, found)
    return [(k, bounds[found[c][0]], bounds[found[c][1]]) for c, k in best_path(field, len(bounds) - 1, found) if each[c, k] >= least]


def _sampled(found: DataFrame, column: str, per_kind: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most per_kind windows of each kind and of none, those that hash lowest; long windows are left to decoding."""
    windows = found.select(F.explode(F.col(column)["windows"]).alias("w")).select("w.text", "w.spans").where(F.length("text") <= 10 * CONTEXT)
    kind = lambda k: F.exists("spans", lambda s: s["kind"] == k) if k < len(KINDS) else F.size("spans") == 0
    order = [F.xxhash64("text"), F.col("text")]
    parts = [windows.where(kind(k)).select("text", "spans").orderBy(*order).limit(per_kind) for k in range(len(KINDS) + 1)]
    rows = {(r["text"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in reduce(DataFrame.unionAll, parts).collect()}
    return [(t, list(s)) for t, s in sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))]


def scan(docs: DataFrame, *, text: str = "text", least: float = 0.8, per_kind: int = 80) -> DataFrame:
    """docs without its text, with base_spans and spans (arrays of kind, start, end; kind an index of KINDS) added, by kind, then start."""
    spark = docs.sparkSession
    small_batches(spark)
    rest = [c for c in docs.columns if c not in (text, "base_spans", "spans")]
    column = unused(rest, "found")

    @F.arrow_udf(FOUND)
    def look(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        window = pa.struct([("start", pa.int32()), ("text", pa.string()), ("spans", kind), ("open", pa.bool_())])
        return pa.array([find(t.as_py() or "") for t in texts], pa.struct([("base", kind), ("windows", pa.list_(window))]))

    found = kept(docs.select(*rest, look(F.col(text)).alias(column)))
    field = train(_sampled(found, column, per_kind))
    base = F.col(column)["base"]
    if field is None:
        return found.select(*rest, base.alias("base_spans"), base.alias("spans"))
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf(SPAN)
    def more(windows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([
            [{"kind": k, "start": w["start"] + s, "end": w["start"] + e} for w in ws.as_py() for k, s, e in decode(shared.value, w["text"], [(x["start"], x["end"]) for x in w["spans"]], least)] for ws in windows
        ], kind)

    open_ = F.filter(F.col(column)["windows"], lambda w: w["open"])
    added = F.when(F.size(open_) > 0, more(open_)).otherwise(F.array().cast(SPAN))
    return found.select(*rest, base.alias("base_spans"), F.array_sort(F.concat(base, added)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op12_pii(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
