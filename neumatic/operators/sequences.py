"""Sequence operators: alignment, rows, section paths, greedy matches.

Groups are a staff line, a page or one score. Spark shuffles rows by the whole
group key and sorts them; a task then reads its groups batch by batch and
solves all groups of one shape (so many rows on either side) at once in numpy,
so that neither a Spark call nor a Python loop is spent per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of sections, and costs of the lyric alignment.
STATES = ("verse", "chorus", "coda", "intro")
SKIP_NOTE, SKIP_WORD, DECAY = 0.34, 1.15, 2.4
PIXEL_NOTE, PIXEL_SLUR, PIXEL_WORD, PIXEL_OTHER, PIXEL_CONTINUED, PIXEL_GATE, PIXEL_DECAY = 0.6, 0.15, 3.0, 1.2, 0.5, 2.5, 0.8
DOUBT, ACCEPT = 0.35, 0.55

_CELLS = 1 << 21  # cells of one numpy step
_ROWS = 1 << 17  # rows that are gathered before they are solved: the more, the more groups of one shape a numpy step has
_LETTERS = 1 << 24  # letters of the strings that are gathered at most


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Batches in lists of at least _ROWS rows; the last may have fewer."""
    tables: list[pa.Table] = []
    rows = 0
    for batch in batches:
        tables.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows >= _ROWS:
            yield tables
            tables, rows = [], 0
    if tables:
        yield tables


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows come sorted by key) with the first row of each group and the end."""
    rest: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, len(table) - 1), bool)
        for i in range(n_keys):
            k = table.column(i).to_numpy()
            change |= k[1:] != k[:-1]
        return np.r_[0, np.flatnonzero(change) + 1]

    for tables in _gathered(batches):
        table = pa.concat_tables([rest, *tables] if rest is not None else tables).combine_chunks()
        first = starts(table) if len(table) else np.zeros(1, np.int64)
        if first[-1]:
            yield table.slice(0, first[-1]), first
        rest = table.slice(first[-1])
    if rest is not None and len(rest):
        yield rest, np.r_[0, len(rest)]


def _fields(frame: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)


def _matched(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], solve: Callable, values: list[tuple[str, str]], kept: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, left id, right id or null, values) for each left row, by `solve` on all groups of one shape.

    Both sides have keys, id and numbers a, b, c, d. solve takes dictionaries
    of [groups, rows] arrays and returns the right place of each left row (-1
    for none) and arrays of the values. `kept` are numbers of the left side that
    stay with their rows, as left_<number>; of the right side the largest of the
    group stays, as right_<number>.
    """
    numbers = ["a", "b", "c", "d"]
    both = left.select(*keys, F.lit(0).alias("side"), "id", *numbers).unionAll(right.select(*keys, F.lit(1).alias("side"), "id", *numbers))
    both = both.repartition(*keys).sortWithinPartitions(*keys, "side", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _groups(batches, len(keys)):
            side, ident = table.column("side").to_numpy(), table.column("id").to_numpy()
            number = {c: table.column(c).to_numpy() for c in numbers}
            m = np.add.reduceat(side, first[:-1])
            n = np.diff(first) - m
            shape = n * (int(m.max()) + 1) + m
            for s in np.unique(shape):
                these = np.flatnonzero(shape == s)
                rows, cols = int(n[these[0]]), int(m[these[0]])
                if not rows:
                    continue
                step = max(1, _CELLS // ((rows + 1) * (cols + 1)))
                for i in range(0, len(these), step):
                    at = first[these[i : i + step]]
                    lefts, rights = at[:, None] + np.arange(rows), at[:, None] + rows + np.arange(cols)
                    if cols:
                        place, found = solve({c: v[lefts] for c, v in number.items()}, {c: v[rights] for c, v in number.items()}, ident[rights])
                        other = np.where(place >= 0, ident[rights[np.arange(len(at))[:, None], np.maximum(place, 0)]], 0).ravel()
                    else:
                        place, found, other = np.full(lefts.shape, -1), [np.zeros(lefts.shape)] * len(values), np.zeros(lefts.size, np.int64)
                    none = (place < 0).ravel()
                    flat = pa.array(lefts.ravel())
                    columns = [table.column(k).take(flat).combine_chunks() for k in keys] + [pa.array(ident[lefts.ravel()]), pa.array(other, pa.int64(), mask=none)]
                    columns += [pa.array(np.asarray(v, float).ravel(), mask=none) for v in found]
                    for c in kept:
                        most = number[c][rights].max(axis=1) if cols else np.zeros(len(at))
                        columns += [pa.array(number[c][lefts.ravel()]), pa.array(np.repeat(most, rows))]
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "id", "other", *[name for name, _ in values], *more])

    more = [f"{side}_{c}" for c in kept for side in ("left", "right")]
    schema = f"{_fields(left, keys)}, id long, other long" + "".join(f", {name} {kind}" for name, kind in [*values, *((c, "double") for c in more)])
    return both.mapInArrow(run, schema)


def _spread(x: np.ndarray) -> np.ndarray:
    """Positions of each group from 0 to 1; 0.5 where they are all one."""
    low, span = x.min(axis=1, keepdims=True), np.ptp(x, axis=1)[:, None]
    return np.where(span > 0, (x - low) / np.where(span > 0, span, 1), 0.5)


def monotonic_match(pair: np.ndarray, skip_left: np.ndarray, skip_right: np.ndarray) -> np.ndarray:
    """Cheapest monotonic matching of each group: the right place of each left row, or -1.

    pair [groups, n, m] are costs of matches, skip_left [groups, n] and
    skip_right [groups, m] of leaving a row out. Cells of one anti-diagonal are
    computed together; of equal costs a match comes first, then leaving out the
    right row.
    """
    g, n, m = pair.shape
    cost = np.full((g, n + 1, m + 1), np.inf)
    cost[:, 0, :] = np.cumsum(np.concatenate([np.zeros((g, 1)), skip_right], axis=1), axis=1)
    cost[:, :, 0] = np.cumsum(np.concatenate([np.zeros((g, 1)), skip_left], axis=1), axis=1)
    came = np.full((g, (n + 1) * (m + 1)), 2, np.int8)
    came[:, 1 : m + 1] = 1
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        options = np.stack([cost[:, i - 1, j - 1] + pair[:, i - 1, j - 1], cost[:, i, j - 1] + skip_right[:, j - 1], cost[:, i - 1, j] + skip_left[:, i - 1]])
        best = options.argmin(axis=0)
        came[:, i * (m + 1) + j] = best
        cost[:, i, j] = np.take_along_axis(options, best[None], axis=0)[0]
    place, all_ = np.full((g, n), -1), np.arange(g)
    at = np.full(g, n * (m + 1) + m)
    while (live := at > 0).any():
        step = came[all_, at]
        i, j = np.divmod(at, m + 1)
        hit = live & (step == 0)
        place[all_[hit], i[hit] - 1] = j[hit] - 1
        at = np.where(live, at - np.choose(step, [m + 2, 1, m + 1]), 0)
    return place


def align_lyrics(words: DataFrame, notes: DataFrame, keys: list[str], *, pixel: bool = False, threshold: float = ACCEPT, flags: bool = False) -> DataFrame:
    """Each word with its note, spatial error, confidence, status and reason, per group of `keys`.

    words: keys, word_id, x, confidence, and for `pixel` known (a syllable of
    the lexicon; leaving it out costs more) and geometry_review (never accepted
    by itself); notes: keys, note_id, x, slurred, and continued (inside a slur
    that began before). With `pixel`, x is in staff spaces and matches further
    than the gate are impossible; else positions are spread over the line.
    Words without a note are `no_note_candidate`. With `flags`, geometry_review
    of the word and fallback (of any note of the group, whose column it is) are
    returned; they go with the rows, so that nothing is joined.
    """
    number = lambda f, c, other: F.col(c).cast("double") if c in f.columns else F.lit(float(other))
    w = words.select(*keys, F.col("word_id").cast("long").alias("id"), F.col("x").cast("double").alias("a"), F.col("confidence").cast("double").alias("b"), number(words, "known", 1).alias("c"), F.coalesce(number(words, "geometry_review", 0), F.lit(0.0)).alias("d"))
    n = notes.select(*keys, F.col("note_id").cast("long").alias("id"), F.col("x").cast("double").alias("a"), number(notes, "slurred", 0).alias("b"), number(notes, "continued", 0).alias("c"), F.coalesce(number(notes, "fallback", 0), F.lit(0.0)).alias("d"))

    def solve(left: dict, right: dict, _: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        x, y = left["a"], right["a"]
        if not pixel:
            low, span = y.min(axis=1, keepdims=True), np.ptp(y, axis=1)[:, None]
            if x.shape[1] == 1 and y.shape[1] > 1:
                x = np.where(span > 0, np.clip((x - low) / np.where(span > 0, span, 1), 0, 1), 0.5)
            else:
                x = _spread(x)
            y = _spread(y)
        off = np.abs(x[:, :, None] - y[:, None, :])
        pair = off + ((1 - np.clip(left["b"], 0, 1)) * DOUBT)[:, :, None]
        if pixel:
            pair = np.where(off > PIXEL_GATE, np.inf, pair) + PIXEL_CONTINUED * (right["c"] > 0)[:, None, :]
            place = monotonic_match(pair, np.where(left["c"] > 0, PIXEL_WORD, PIXEL_OTHER), np.where(right["b"] > 0, PIXEL_SLUR, PIXEL_NOTE))
        else:
            place = monotonic_match(pair, np.full(x.shape, SKIP_WORD), np.full(y.shape, SKIP_NOTE))
        return place, [np.take_along_axis(off, np.maximum(place, 0)[:, :, None], axis=2)[:, :, 0], left["b"]]

    found = _matched(w, n, keys, ["a", "id"], solve, [("error", "double"), ("ocr", "double")], "d")
    confidence = F.round(F.least(F.greatest("ocr", F.lit(0.0)), F.lit(1.0)) * F.exp(F.lit(-(PIXEL_DECAY if pixel else DECAY)) * F.col("error")), 6)
    flagged, mixed = F.col("left_d") > 0, F.col("right_d") > 0
    out = found.select(*keys, F.col("id").alias("word_id"), F.col("other").alias("note_id"), F.round("error", 6).alias("error"), confidence.alias("confidence"), flagged.alias("geometry_review"), mixed.alias("fallback"))
    status = F.when(F.col("note_id").isNull(), "no_note_candidate").when((F.col("confidence") >= threshold) & ~F.col("geometry_review"), "accepted").otherwise("needs_review")
    return out.select(*keys, "word_id", "note_id", "error", "confidence", status.alias("status"), *(["geometry_review", "fallback"] if flags else []))


def greedy_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Each truth box in order takes the unused predicted box of the best overlap (the first on ties), if it is at least `least`.

    Both: keys, box_id, x1, y1, x2, y2.
    """
    side = lambda f: f.select(*keys, F.col("box_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), "abcd")])

    def solve(t: dict, p: dict, _: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        wide = lambda low, high: np.maximum(0, np.minimum(t[high][:, :, None], p[high][:, None, :]) - np.maximum(t[low][:, :, None], p[low][:, None, :]))
        area = lambda s: (s["c"] - s["a"]) * (s["d"] - s["b"])
        both = wide("a", "c") * wide("b", "d")
        share = both / np.maximum(area(t)[:, :, None] + area(p)[:, None, :] - both, 1)
        place, best = np.full(t["a"].shape, -1), np.zeros(t["a"].shape)
        free, all_ = np.ones((len(share), share.shape[2]), bool), np.arange(len(share))
        for i in range(share.shape[1]):
            now = np.where(free, share[:, i], -1)
            j = now.argmax(axis=1)
            took = now[all_, j] >= least
            place[took, i], best[took, i] = j[took], now[all_, j][took]
            free[all_[took], j[took]] = False
        return place, [best]

    found = _matched(side(truth), side(predicted), keys, ["id"], solve, [("overlap", "double")])
    return found.where("other is not null").select(*keys, F.col("id").alias("truth_id"), F.col("other").alias("predicted_id"), "overlap")


def match_unused(words: DataFrame, notes: DataFrame, keys: list[str], within: float = 2.5) -> DataFrame:
    """Words in order of place take the nearest note within reach, an unused one first (then the smallest id)."""
    side = lambda f, i: f.select(*keys, F.col(i).cast("long").alias("id"), F.col("x").cast("double").alias("a"), *[F.lit(0.0).alias(c) for c in "bcd"])

    def solve(w: dict, n: dict, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        off = np.abs(w["a"][:, :, None] - n["a"][:, None, :])
        place, used, all_ = np.full(w["a"].shape, -1), np.zeros(ids.shape, bool), np.arange(len(ids))
        for i in range(off.shape[1]):
            order = np.lexsort((ids, off[:, i], used, off[:, i] > within))
            j = order[:, 0]
            took = off[all_, i, j] <= within
            place[took, i] = j[took]
            used[all_[took], j[took]] = True
        return place, []

    found = _matched(side(words, "word_id"), side(notes, "note_id"), keys, ["a", "id"], solve, [])
    return found.where("other is not null").select(*keys, F.col("id").alias("word_id"), F.col("other").alias("note_id"))


def rows_of(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Text rows by vertical place: a box joins the row whose median centre is nearest, within 0.6 median heights.

    boxes: keys, box_id, cx, cy, h. Adds row (from 0, in order of appearance)
    and place in it. Boxes come from top to bottom, so the nearest row is
    always the last one begun, and its median is a look-up in its sorted
    centres: one pass, whatever the number of rows.
    """
    source = boxes.select(*keys, F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "h")])
    source = source.repartition(*keys).sortWithinPartitions(*keys, "cy", "cx", "box_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _groups(batches, len(keys)):
            cy, group = table.column("cy").to_numpy(), np.repeat(np.arange(len(first) - 1), np.diff(first))
            height = np.maximum(table.column("h").to_numpy(), 1.0)
            by = np.lexsort((height, group))
            middle = first[:-1] + np.diff(first) // 2
            limit = 0.3 * (height[by][middle] + height[by][np.maximum(first[:-1], middle - 1 + np.diff(first) % 2)])
            row, centres = np.zeros(len(cy), np.int64), cy.tolist()
            for a, b, most in zip(first[:-1].tolist(), first[1:].tolist(), limit.tolist()):
                begun, n = a, 0
                for i in range(a + 1, b):
                    half = begun + i - 1
                    if centres[i] - (centres[half // 2] + centres[(half + 1) // 2]) / 2 > most:
                        begun, n = i, n + 1
                    row[i] = n
            place = np.empty(len(cy), np.int64)
            by = np.lexsort((table.column("box_id").to_numpy(), table.column("cx").to_numpy(), row, group))
            new = np.r_[True, (np.diff(row[by]) != 0) | (np.diff(group[by]) != 0)]
            place[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            columns = [table.column(c).combine_chunks() for c in (*keys, "box_id")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row), pa.array(place)], [*keys, "box_id", "text_row", "place"])

    return source.mapInArrow(run, f"{_fields(boxes, keys)}, box_id long, text_row long, place long")


def emissions(count: Column, verse_count: Column, explicit: Column, last: Column, marker: Column, repeated: Column) -> Column:
    """Scores of the four section labels of a frame; a marker decides alone, a repeated single row adds to chorus."""
    base = {
        "verse": F.when(count == verse_count, 3).otherwise(0) + F.when(explicit, 2).otherwise(0),
        "chorus": F.when((count == 1) & (verse_count >= 2), 3).otherwise(0),
        "coda": F.when(last, 1).otherwise(0),
        "intro": F.when(count == 0, 3).otherwise(-3),
    }
    own = lambda s: F.when(marker.isNotNull(), F.when(marker == s, 10).otherwise(-100)).otherwise(base[s])
    return F.array(own("verse"), own("chorus") + F.when(repeated & (count == 1), 1).otherwise(0), own("coda"), own("intro"))


def common_bounds(a: list[str], b: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """At least the letters that a[left] and b[right] have in common in order, for each pair, letters taken in 64 classes.

    The longest common subsequence by bits: a word of 64 letters of `a` and all
    pairs at once, a letter of `b` at a time.
    """
    size = np.array([len(s) for s in b], np.int64)
    words = max(1, -(-max(map(len, a), default=0) // 64))
    letters = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) % 64 for side in (a, b)]
    lengths = np.array([len(s) for s in a], np.int64)
    masks = np.zeros((len(a), 64, words), np.uint64)
    place = np.arange(len(letters[0])) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(a)), lengths), letters[0], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    start, by = np.cumsum(size) - size, np.argsort(-size[right], kind="stable")
    left, at, size = left[by], start[right[by]], size[right[by]]
    row = np.full((words, len(by)), ~np.uint64(0))
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t))  # pairs whose right side has more than t letters
        hit, carry = masks[left[:live], letters[1][at[:live] + t]], np.zeros(live, np.uint64)
        for w in range(words):
            v = row[w, :live]
            u = v & hit[:, w]
            total = v + u
            again = total + carry
            carry = ((total < v) | (again < total)).astype(np.uint64)
            row[w, :live] = again | (v - u)
    out = np.empty(len(by), np.int64)
    out[by] = np.bitwise_count(~row).sum(axis=0)
    return out


_BOUNDED = 4096  # letters of the longest string for which common_bounds() is asked


def _alike(phrase: list[str], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Whether the block_ratios() of phrase[left] and phrase[right] are above `least`; computed only where the letters in common allow it."""
    size = np.array([len(s) for s in phrase], np.int64)
    out = np.zeros(len(left), bool)
    n, m = size[left], size[right]
    words = np.where(np.maximum(n, m) > _BOUNDED, 0, -(-n // 64))
    for w in np.unique(words):
        some = np.flatnonzero(words == w)
        for part in np.array_split(some, max(1, len(some) * int(max(1, w)) // (1 << 16))):
            if w:
                (i, mine), (j, other) = (np.unique(x[part], return_inverse=True) for x in (left, right))
                common = common_bounds([phrase[k] for k in i], [phrase[k] for k in j], mine, other)
                part = part[2.0 * common / np.maximum(n[part] + m[part], 1) > least]
            if len(part):
                out[part] = _ratios([(pd.Series([phrase[k] for k in left[part]], dtype=object), pd.Series([phrase[k] for k in right[part]], dtype=object))]).to_numpy() > least
    return out


def repeated_phrases(frames: DataFrame, keys: list[str], order: str, phrase: str, single: Column, least: float = 0.85) -> DataFrame:
    """keys and order of the single-row frames whose phrase is like that of an earlier frame of their group.

    Only pairs whose lengths and letters allow the ratio are compared. A group
    is moved once; its pairs are made where it is solved.
    """
    known = F.lit(True)
    for k in (*keys, order):
        known &= F.col(k).isNotNull()
    source = frames.where(known).select(*keys, order, F.lower(phrase).alias("_text"), F.coalesce(single, F.lit(False)).alias("_single")).where("_text is not null")
    source = source.repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _groups(batches, len(keys)):
            at, single, phrases = table.column(order).to_numpy(), table.column("_single").to_numpy(), table.column("_text").to_pylist()
            size, found = np.array([len(p) for p in phrases]), np.zeros(len(at), bool)
            lefts, rights, waiting = [], [], 0

            def settle() -> None:
                if waiting:
                    i, j = np.concatenate(lefts), np.concatenate(rights)
                    found[i[_alike(phrases, i, j, least)]] = True
                lefts.clear()
                rights.clear()

            for a, b in zip(first[:-1], first[1:]):
                for i in a + np.flatnonzero(single[a:b]):
                    j = a + np.flatnonzero(at[a:b] < at[i])
                    j = j[2 * np.minimum(size[j], size[i]) > least * (size[j] + size[i])]
                    lefts.append(np.full(len(j), i))
                    rights.append(j)
                    waiting += len(j)
                    if waiting >= _CELLS:
                        settle()
                        waiting = 0
            settle()
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (table.column(k).take(pa.array(np.flatnonzero(found))).combine_chunks() for k in (*keys, order))], [*keys, order])

    return source.mapInArrow(run, f"{_fields(frames, [*keys, order])}").distinct()


def section_path(frames: DataFrame, keys: list[str], order: str, scores: str = "scores") -> DataFrame:
    """Best label of each frame along its group, with +1 for staying and -1 for changing.

    All groups of a batch advance together. Of equally good paths the one whose
    labels are later in the alphabet is kept; its rank among the four paths is
    carried along, so no path is ever written out before the end.
    """
    source = frames.select(*keys, F.col(order).cast("long").alias(order), *[F.get(scores, F.lit(i)).cast("long").alias(f"score_{s}") for i, s in enumerate(STATES)])
    source = source.repartition(*keys).sortWithinPartitions(*keys, order)
    alphabetic = np.array([sorted(STATES).index(s) for s in STATES])
    stay = np.where(np.eye(4, dtype=bool), 1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _groups(batches, len(keys)):
            value = np.stack([table.column(f"score_{s}").to_numpy() for s in STATES], axis=1)
            size = np.diff(first)
            by = np.argsort(-size, kind="stable")
            at, size = first[:-1][by], size[by]
            total, rank = value[at], np.tile(alphabetic, (len(at), 1))
            came = np.zeros((len(value), 4), np.int8)
            for t in range(1, int(size[0])):
                live = int(np.searchsorted(-size, -t))  # groups that have more than t frames
                before = ((total[:live, :, None] + stay) * 4 + rank[:live, :, None]).argmax(axis=1)
                came[at[:live] + t] = before
                rows = np.arange(live)[:, None]
                total[:live] = total[rows, before] + np.where(before == np.arange(4), 1, -1) + value[at[:live] + t]
                rank[:live] = (rank[rows, before] * 4 + alphabetic).argsort(axis=1).argsort(axis=1)
            label = np.zeros(len(value), np.int64)
            label[at + size - 1] = total.argmax(axis=1)
            for t in range(int(size[0]) - 1, 0, -1):
                live = int(np.searchsorted(-size, -t))
                label[at[:live] + t - 1] = came[at[:live] + t, label[at[:live] + t]]
            columns = [table.column(c).combine_chunks() for c in (*keys, order)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(STATES)[label].tolist(), pa.string())], [*keys, order, "label"])

    return source.mapInArrow(run, f"{_fields(frames, keys)}, {order} long, label string")


def verse_count(frames: DataFrame, keys: list[str], order: str, count: str) -> DataFrame:
    """Commonest row count of 2 or more of a group, the one met first on ties; 1 without any."""
    c = frames.where(F.col(count) >= 2).groupBy(*keys, count).agg(F.count("*").alias("times"), F.min(order).alias("first"))
    best = c.groupBy(*keys).agg(F.max_by(count, F.struct("times", -F.col("first"))).alias("verse_count"))
    return frames.select(*keys).distinct().join(best, keys, "left").withColumn("verse_count", F.coalesce("verse_count", F.lit(1)))


def block_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * matched characters / all characters of each pair, by the longest common block and then the same left and right of it.

    All open stretches of one shape (of whatever pair) are searched in one
    table of common suffix lengths; of equally long blocks the first is taken.
    """
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    codes = [np.frombuffer("".join(side).encode("utf-32-le"), np.uint32) for side in (a, b)]
    most = max((int(c.max()) for c in codes if len(c)), default=0)
    codes = [c.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32) for c in codes]
    start = [np.r_[0, np.cumsum(size[:, k])[:-1]].astype(np.int64) for k in (0, 1)]
    matched = np.zeros(len(size), np.int64)
    # pair, begin and length in either string
    todo = np.stack([np.arange(len(size)), np.zeros(len(size), np.int64), size[:, 0], np.zeros(len(size), np.int64), size[:, 1]], axis=1)
    wide = int(size[:, 1].max(initial=0)) + 1
    while len(todo := todo[(todo[:, 2] > 0) & (todo[:, 4] > 0)]):
        following = []
        shape = todo[:, 2] * wide + todo[:, 4]
        by = np.argsort(shape, kind="stable")
        cuts = np.flatnonzero(np.diff(shape[by], prepend=-1, append=-1))
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            same = todo[by[first:end]]
            n, m = int(same[0, 2]), int(same[0, 4])
            for part in np.array_split(same, max(1, len(same) * n * m // _CELLS)):
                x = codes[0][(start[0][part[:, 0]] + part[:, 1])[:, None] + np.arange(n)]
                y = codes[1][(start[1][part[:, 0]] + part[:, 3])[:, None] + np.arange(m)]
                k, end_x, end_y = _longest(x, y)
                hit = k > 0
                pair, x0, n0, y0, m0 = part[hit].T
                k, end_x, end_y = k[hit], end_x[hit], end_y[hit]
                np.add.at(matched, pair, k)
                following.append(np.stack([pair, x0, end_x - k, y0, end_y - k], axis=1))
                following.append(np.stack([pair, x0 + end_x, n0 - end_x, y0 + end_y, m0 - end_y], axis=1))
        todo = np.concatenate(following) if following else todo[:0]
    return np.where(size.sum(axis=1) > 0, 2.0 * matched / np.maximum(size.sum(axis=1), 1), 1.0)


_TABLE = 1 << 12  # cells of a pair up to which the whole table of its suffix lengths is kept


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the longest common block of each row of x and y, and its ends in both; of equally long ones the first."""
    (g, n), m = x.shape, y.shape[1]
    if n * m <= _TABLE:
        run = (x[:, :, None] == y[:, None, :]).astype(np.int8 if min(n, m) < 1 << 7 else np.int16)
        for i in range(1, n):
            run[:, i, 1:] *= run[:, i - 1, :-1] + run.dtype.type(1)
        flat = run.reshape(g, n * m)
        at = flat.argmax(axis=1)
        return flat[np.arange(g), at].astype(np.int64), at // m + 1, at % m + 1
    run, best = np.zeros((g, m + 1), np.int32), np.zeros((3, g), np.int64)
    for i in range(n):
        run[:, 1:] = np.where(x[:, i : i + 1] == y, run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        longest = run[np.arange(g), j]
        better = longest > best[0]
        best[:, better] = np.stack([longest, np.full(g, i + 1), j])[:, better]
    return best[0], best[1], best[2]


def _ratios(parts: list[tuple[pd.Series, pd.Series]]) -> pd.Series:
    """block_ratios() of the rows of all parts, once per distinct pair; null if either is null."""
    a, b = (pd.concat([p[i] for p in parts], ignore_index=True) for i in (0, 1))
    given = (a.notna() & b.notna()).to_numpy()
    (left, lefts), (right, rights) = (pd.factorize(c[given]) for c in (a, b))
    known, at = np.unique(left.astype(np.int64) * (len(rights) + 1) + right, return_inverse=True)
    i, j = np.divmod(known, len(rights) + 1)
    out = np.full(len(a), np.nan)
    if len(known):
        out[given] = block_ratios(lefts[i].tolist(), rights[j].tolist())[at]
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """block_ratios() of two string columns; null if either is null. Rows are gathered up to _ROWS or _LETTERS, so that pairs of one shape are many."""
    parts, rows, letters = [], 0, 0
    for a, b in batches:
        parts.append((a, b))
        rows, letters = rows + len(a), letters + a.str.len().sum() + b.str.len().sum()
        if rows >= _ROWS or letters >= _LETTERS:
            yield _ratios(parts)
            parts, rows, letters = [], 0, 0
    if parts:
        yield _ratios(parts)


_WORDS = 1 << 19  # words of texts that are compared together at most, but for a longer text


def neighbour_ratios(texts: DataFrame, words: str) -> DataFrame:
    """texts without `words` (an array of strings, none null) and with `ratios`: block_ratios() of each word and the next one, once per distinct pair."""
    names = [c for c in texts.columns if c != words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch[words].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // _WORDS
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1:] + 1)) if len(part) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                few = batch.slice(a, b - a)
                held = few[words].flatten().dictionary_encode()
                code, known = held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary.to_pylist()
                text = np.repeat(np.arange(b - a), sizes[a:b])
                at = np.flatnonzero(text[1:] == text[:-1])
                pairs, back = np.unique(code[at] * len(known) + code[at + 1], return_inverse=True)
                left, right = np.divmod(pairs, max(1, len(known)))
                value = block_ratios([known[i] for i in left.tolist()], [known[j] for j in right.tolist()])[back] if len(pairs) else np.zeros(0)
                ends = np.concatenate([[0], np.cumsum(np.maximum(sizes[a:b] - 1, 0))]).astype(np.int32)
                plain = [few[c].cast(pa.list_(few[c].type.value_type)) if pa.types.is_list(few[c].type) else few[c] for c in names]
                yield pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(ends), pa.array(value, pa.float64()))], names=[*names, "ratios"])

    return texts.mapInArrow(run, f"{_fields(texts, names)}, ratios array<double>" if names else "ratios array<double>")


def edit_distances(a: list[list], b: list[list]) -> np.ndarray:
    """Least insertions, deletions and replacements that turn each sequence of `a` into that of `b`; pairs of one shape together, a row of the table at a time."""
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    codes, _ = pd.factorize(np.array([t for s in (*a, *b) for t in s], dtype=object), use_na_sentinel=False)
    return _edits(size, codes)


def _edits(size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """edit_distances() of pairs of these sizes; codes are the items as numbers, those of all left sides and then those of all right sides."""
    ends = np.cumsum(np.r_[size[:, 0], size[:, 1]])
    start = (np.r_[0, ends[:-1]] if len(ends) else ends).reshape(2, -1)
    codes, out = codes.astype(np.int32), np.zeros(len(size), np.int64)
    shape = size[:, 0] * (int(size[:, 1].max(initial=0)) + 1) + size[:, 1]
    by = np.argsort(shape, kind="stable")
    cuts = np.flatnonzero(np.diff(shape[by], prepend=-1, append=-1)).tolist()
    for first, end in zip(cuts[:-1], cuts[1:]):
        these = by[first:end]
        n, m = size[these[0]].tolist()
        for part in np.array_split(these, max(1, len(these) * (m + 1) // (_CELLS >> 6))):
            x, y = (codes[start[k, part][:, None] + np.arange(w)] for k, w in ((0, n), (1, m)))
            place = np.arange(m + 1, dtype=np.int32)
            # the row of the table less its place, so that insertions are a running minimum
            row = np.zeros((len(part), m + 1), np.int32)
            for i in range(n):
                best = np.empty_like(row)
                best[:, 0] = i + 1
                np.minimum(row[:, :-1] - (x[:, i : i + 1] == y), row[:, 1:] + 1, out=best[:, 1:])
                row = np.minimum.accumulate(best, axis=1)
            out[part] = row[:, -1] + place[-1]
    return out


@F.arrow_udf(T.LongType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """edit_distances() of two array columns; null if either is null."""
    known = pa.compute.and_(a.is_valid(), b.is_valid())
    sides = [side.filter(known) for side in (a, b)]
    size = np.stack([side.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for side in sides], axis=1)
    items = pa.concat_arrays([side.flatten().cast(sides[0].type.value_type) for side in sides]).dictionary_encode(null_encoding="encode")
    out = np.zeros(len(a), np.int64)
    given = known.to_numpy(zero_copy_only=False)
    out[given] = _edits(size, items.indices.to_numpy(zero_copy_only=False))
    return pa.array(out, mask=~given)


_HIGH, _MASKS = np.uint64(63), 1 << 22  # masks of letters that are held at once


def letter_distances(a: list[str], b: list[str]) -> np.ndarray:
    """edit_distances() of the letters of strings, 64 letters of `a` at a time by bits (Myers), a letter of `b` and all pairs at once."""
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, codes = np.unique(codes, return_inverse=True)
    out = size.sum(axis=1)
    ends = np.cumsum(size.T.ravel())
    start = np.r_[0, ends[:-1]].reshape(2, -1) if len(ends) else np.zeros((2, 0), np.int64)
    words = -(-size[:, 0] // 64)
    far = (size.max(axis=1, initial=0) > _BOUNDED) & (size.min(axis=1, initial=1 << 62) > 0)
    for i in np.flatnonzero(far):
        one = [codes[start[k, i] : start[k, i] + size[i, k]] for k in (0, 1)]
        out[i] = _edits(size[i : i + 1], np.concatenate(one))[0]
    for w in np.unique(words[~far & (size.min(axis=1, initial=1 << 62) > 0)]).tolist():
        these = np.flatnonzero((words == w) & ~far & (size[:, 1] > 0))
        these = these[np.argsort(-size[these, 1], kind="stable")]
        for part in np.array_split(these, max(1, len(these) * w * len(kinds) // _MASKS)):
            if not len(part):
                continue
            g, left, right = len(part), size[part, 0], size[part, 1]
            place = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left)
            letter = codes[np.repeat(start[0, part], left) + place]
            masks = np.zeros((len(kinds), w, g), np.uint64)
            np.bitwise_or.at(masks, (letter, place // 64, np.repeat(np.arange(g), left)), np.uint64(1) << (place % 64).astype(np.uint64))
            up, down = np.full((w, g), ~np.uint64(0)), np.zeros((w, g), np.uint64)
            last = ((left - 1) % 64).astype(np.uint64)
            score = left.copy()
            for t in range(int(right[0])):
                live = int(np.searchsorted(-right, -t))  # pairs whose right side has more than t letters
                hit = masks[codes[start[1, part[:live]] + t], :, np.arange(live)]
                plus, minus = np.ones(live, np.uint64), np.zeros(live, np.uint64)
                for k in range(w):
                    p, m, eq = up[k, :live], down[k, :live], hit[:, k]
                    xv, eq = eq | m, eq | minus
                    xh = (((eq & p) + p) ^ p) | eq
                    ph, mh = m | ~(xh | p), p & xh
                    if k == w - 1:
                        score[:live] += ((ph >> last[:live]) & np.uint64(1)).astype(np.int64) - ((mh >> last[:live]) & np.uint64(1)).astype(np.int64)
                    ph_in, mh_in = (ph << np.uint64(1)) | plus, (mh << np.uint64(1)) | minus
                    plus, minus = ph >> _HIGH, mh >> _HIGH
                    up[k, :live] = mh_in | ~(xv | ph_in)
                    down[k, :live] = ph_in & xv
            out[part] = score
    return out


@F.arrow_udf(T.LongType())
def letter_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """letter_distances() of two columns of strings; null if either is null."""
    given = pa.compute.and_(a.is_valid(), b.is_valid())
    out = np.zeros(len(a), np.int64)
    some = given.to_numpy(zero_copy_only=False)
    out[some] = letter_distances(a.filter(given).to_pylist(), b.filter(given).to_pylist())
    return pa.array(out, mask=~some)


# How far below its staff a row may lie (staff heights), and how close to the row above it (row heights).
FAR, GAP_UP, GAP_DOWN = 2.0, 0.3, 1.6


def assign_rows(rows: DataFrame, staves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, staff_id, verse and ambiguous: the staff below which each text row lies, in order from top to bottom.

    rows: keys, row_id, x1, y1, x2, y2, sung (a lyric row); staves: keys,
    staff_id, x1, y1, x2, y2. A staff can take a row that overlaps it sideways,
    lies below it and above the next staff, and is near: within twice its height
    or close under the sung row that it took last. The nearest staff wins; sung
    rows count its verses. Rows of a page are few and depend on those before.
    """
    box = ["x1", "y1", "x2", "y2"]
    r = rows.select(*keys, F.lit(1).alias("side"), F.col("row_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in box], F.col("sung").cast("boolean").alias("sung"))
    s = staves.select(*keys, F.lit(0).alias("side"), F.col("staff_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in box], F.lit(False).alias("sung"))
    both = s.unionAll(r).repartition(*keys).sortWithinPartitions(*keys, "side", "y1", "x1", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _groups(batches, len(keys)):
            side, ident, sung = (table.column(c).to_numpy() for c in ("side", "id", "sung"))
            place = np.stack([table.column(c).to_numpy() for c in box], axis=1)
            took = []
            for a, b in zip(first[:-1], first[1:]):
                middle = a + int((side[a:b] == 0).sum())
                staff, high = place[a:middle], place[a:middle, 3] - place[a:middle, 1]
                prior, verses = np.full((middle - a, 2), np.nan), np.zeros(middle - a, np.int64)
                # where the next staff below each staff begins
                tops = np.r_[np.sort(staff[:, 1]), np.inf]
                next_top = tops[np.searchsorted(tops[:-1], staff[:, 3], "right")]
                for i in range(middle, b):
                    x1, y1, x2, y2 = place[i]
                    under = y1 - staff[:, 3]
                    gap, tall = y1 - prior[:, 1], prior[:, 1] - prior[:, 0]
                    close = (gap >= -GAP_UP * np.minimum(tall, y2 - y1)) & (gap <= GAP_DOWN * np.maximum(np.maximum(tall, y2 - y1), 1))
                    # the next staff begins below this one and above the end of the row
                    blocked = next_top < y2
                    off = (y1 + y2) / 2 - staff[:, 3]
                    able = (np.minimum(x2, staff[:, 2]) > np.maximum(x1, staff[:, 0])) & (under >= 0) & ~blocked & ((off <= FAR * np.maximum(high, 1)) | close)
                    best = int(np.where(able, off, np.inf).argmin()) if able.any() else -1
                    if best >= 0 and sung[i]:
                        verses[best] += 1
                        prior[best] = y1, y2
                    took.append((i, ident[a + best] if best >= 0 else None, int(verses[best]) if best >= 0 and sung[i] else None, bool(able.sum() > 1)))
            at = pa.array([t[0] for t in took], pa.int64())
            columns = [table.column(c).take(at).combine_chunks() for c in (*keys, "id")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t[1] for t in took], pa.int64()), pa.array([t[2] for t in took], pa.int64()), pa.array([t[3] for t in took], pa.bool_())], [*keys, "row_id", "staff_id", "verse", "ambiguous"])

    return both.mapInArrow(run, f"{_fields(rows, keys)}, row_id long, staff_id long, verse long, ambiguous boolean")
