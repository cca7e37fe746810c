"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's lattice is the chain of its pre-tokens' lattices (see unigram). Each
node's outgoing edges carry the conditional probability of the next piece, so
a walk from the start draws a segmentation with its unigram probability. For k
distinct ones the search keeps, per text, a queue of open sets of
segmentations: "as this path up to here, then any piece but the ones taken".
The best perturbed score in a set is a Gumbel variable at the set's log mass,
cut off at the perturbed score of the segmentation it branched from; this is
the A-star bound and it is exact, so the set with the best bound holds the
next best segmentation. Popping it draws its piece, splits off what remains of
the set, and walks on to the end. Perturbed scores thus come out in falling
order: Gumbel top-k without replacement. With kappa the (k+1)-th score, a
segmentation's inclusion score is 1 - exp(-exp(log p - kappa)).

All texts of a slice walk together in numpy; noise comes from hashes of row
key, rank, position and step, so a row gives the same result on any cluster.

Defined results: null and empty texts have one segmentation without pieces;
texts with fewer than k segmentations return them all, with inclusion 1; rows
without a key are seeded by 0; rows of equal key and text give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import small_batches
from ._text import Prefix, Table, distinct, mix, slices
from .unigram import DEFAULT_MODEL, MARK, Vocabulary, pretokens


LITERAL = 0x110001  # a "▁" of the text itself; in no piece


class Pieces:
    """The vocabulary by hash of code points, for look-ups of many spans at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_score, self.longest = vocabulary.byte_score, vocabulary.longest
        texts = list(vocabulary.pieces)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(t) for t in texts])
        h = Prefix(points).span(np.r_[0, end[:-1]], end)
        self.table = Table(h, np.arange(len(texts)))
        self.id = np.array([vocabulary.pieces[t][0] for t in texts], np.int64)
        self.score = np.array([vocabulary.pieces[t][1] for t in texts])
        starts = np.r_[0, end[:-1]]
        self.begun = np.zeros(1 << 22, bool)  # hashes of all beginnings of pieces
        for size in range(1, self.longest + 1):
            long_enough = starts[end - starts >= size]
            self.begun[(Prefix(points).span(long_enough, long_enough + size) >> np.uint64(42)).astype(np.int64)] = True
        lengths = np.array([len(x) for x in vocabulary.spelling])
        self.spelt_at, self.spelt_len = np.cumsum(lengths) - lengths, lengths
        self.spelt = np.frombuffer(b"".join(vocabulary.spelling), np.uint8)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)

    def spell_out(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with those below 0 (-1 - code point) as byte pieces, and the ids each of them gave."""
        point = np.where(ids < 0, -1 - ids, 0)
        count = np.where(ids < 0, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        out = np.repeat(ids, count)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            nth = odd - np.repeat(np.cumsum(count) - count, count)[odd]
            point, size = -1 - out[odd], np.repeat(count, count)[odd]
            bits = point >> (6 * (size - 1 - nth))
            out[odd] = self.byte_ids[np.where(nth > 0, bits & 0x3F | 0x80, bits | np.array([0, 0, 0xC0, 0xE0, 0xF0])[size])]
        return out, count

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a sequence of ids, and how many each gave."""
        size = self.spelt_len[ids]
        return self.spelt[np.repeat(self.spelt_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places."""
        real, place = self.table.get(h)
        hit = np.flatnonzero(real)
        return hit, place[hit]


def _grouped(left: np.ndarray, source: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order by left, then source, then as in `start`; stable sorts of 16-bit keys are linear."""
    order = start
    for key in (source & 0xFFFF, source >> 16 & 0xFFFF, source >> 32, left & 0xFFFF, left >> 16):
        if len(key) and (key != key[0]).any():
            order = order[np.argsort(key[order].astype(np.uint16), kind="stable")]
    return order


class Lattices:
    """Lattices of distinct pre-tokens as flat arrays.

    Node p + 1 is before symbol p, node 0 is the end of every pre-token. The
    edges of a node are consecutive; `logq` is the log of an edge's conditional
    probability, `below` the probability of the node's edges up to it, `piece`
    its id, or -1 - code point where the symbol is spelt in bytes.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray):
        size = end - start
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
        raw = data[at]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        leads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        byte_end = np.cumsum(size)
        count = leads[byte_end] - leads[byte_end - size]
        length = count + marked
        self.begin = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if len(length) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(length)), length)
        n = len(word)
        symbol = np.full(n, ord(MARK), np.uint32)
        body = np.ones(n, bool)
        body[self.begin[marked]] = False
        symbol[body] = np.where(points == ord(MARK), LITERAL, points)
        lone = np.flatnonzero(~marked & (size == 1))
        lone = self.begin[lone[data[start[lone]] == 0x20]]
        symbol[lone] = ord(MARK)
        stop = (self.begin + length)[word]
        prefix = Prefix(symbol)
        at = np.arange(n)
        source, reach, piece, score = [], [], [], []
        p = at
        for size in range(1, pieces.longest + 1):
            if size > 1:
                p = p[p + size <= stop[p]]
            if not len(p):
                break
            h = prefix.span(p, p + size)
            begun = pieces.begun[(h >> np.uint64(42)).astype(np.int64)]
            if size > 1:
                p, h = p[begun], h[begun]
            hit, place = pieces.find(h)
            source.append(p[hit])
            reach.append(np.full(len(hit), size))
            piece.append(pieces.id[place])
            score.append(pieces.score[place])
            if size == 1:
                spelt = np.ones(n, bool)
                spelt[hit] = False
                spelt = np.flatnonzero(spelt)
                point = np.where(symbol[spelt] == LITERAL, ord(MARK), symbol[spelt]).astype(np.int64)
                source.append(spelt)
                reach.append(np.ones(len(spelt), np.int64))
                piece.append(-1 - point)
                score.append((1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)) * pieces.byte_score)
                p = p[begun]
        source, reach, piece, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (source, reach, piece, score))
        left = (stop - at)[source] if n else source
        order = _grouped(left, source, np.arange(len(source))[::-1])  # longest piece first: it is mostly the one drawn
        source, reach, piece, score, left = (x[order] for x in (source, reach, piece, score, left))
        target = np.where(reach == left, 0, source + reach + 1)
        # backward mass, by symbols left: an edge ends where fewer are left
        beta, logq = np.zeros(n + 1), np.empty(len(source))
        cuts = np.searchsorted(left, np.arange(1, (left[-1] if len(left) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            value, own = score[a:b] + beta[target[a:b]], source[a:b]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            fan = np.diff(np.r_[new, b - a])
            top = np.maximum.reduceat(value, new)
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, fan)), new))
            beta[own[new] + 1] = total
            logq[a:b] = value - np.repeat(total, fan)
        self.source, self.target, self.piece, self.logq = source + 1, target, piece, np.minimum(logq, 0.0)
        self.fan = np.bincount(self.source, minlength=n + 1)
        self.first = np.zeros(n + 1, np.int64)
        new = np.flatnonzero(np.r_[True, source[1:] != source[:-1]][: len(source)])
        self.first[self.source[new]] = new
        fan = np.diff(np.r_[new, len(source)])
        self.below = np.exp(self.logq)
        more, nth = new[fan > 1], 1
        while len(more):  # summed node by node, so that it does not depend on what else is in the slice
            self.below[more + nth] += self.below[more + nth - 1]
            nth += 1
            more = more[self.fan[self.source[more]] > nth]
        if len(new):
            self.below[new + fan - 1] = 1.0
        with np.errstate(divide="ignore"):
            self.rest = np.log1p(-np.minimum(1.0, np.exp(self.logq)))  # log mass of the other edges of the node
        self.rest[np.repeat(fan, fan) == 1] = -np.inf


class Known:
    """Lattices of the pre-tokens that a task has met, each built once; begun anew when there are more than `most` symbols.

    The arrays are those of Lattices, with room at their end.
    """

    EDGES = {"source": np.int32, "target": np.int32, "piece": np.int32, "logq": np.float64, "below": np.float64, "rest": np.float64}
    NODES = {"fan": np.int32, "first": np.int32}

    def __init__(self, pieces: Pieces, most: int = 1 << 20):
        self.pieces, self.most = pieces, most
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.starts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.n_edges, self.n_nodes = 0, 1
        for name, kind in (self.EDGES | self.NODES).items():
            setattr(self, name, np.zeros(1 << 10, kind))

    def _append(self, names: dict, used: int, values: dict) -> None:
        for name in names:
            have, own = getattr(self, name), values[name]
            if used + len(own) > len(have):
                have = np.concatenate([have[:used], np.zeros(used + 2 * len(own), have.dtype)])
                setattr(self, name, have)
            have[used : used + len(own)] = own

    def nodes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The first node of each pre-token. Nodes given before hold until the next call."""
        if self.n_nodes > self.most:
            self._clear()
        lead, inverse = distinct(h)
        own = h[lead]
        at = np.searchsorted(self.hashes, own)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != own) if len(self.hashes) else np.arange(len(own))
        if len(new):
            fresh = lead[new]
            lat = Lattices(self.pieces, data, start[fresh], end[fresh], marked[fresh])
            up = self.n_nodes - 1
            values = {"source": lat.source + up, "target": np.where(lat.target, lat.target + up, 0), "first": lat.first[1:] + self.n_edges, "fan": lat.fan[1:]}
            self._append(self.EDGES, self.n_edges, values | {name: getattr(lat, name) for name in ("piece", "logq", "below", "rest")})
            self._append(self.NODES, self.n_nodes, values)
            begin = lat.begin + 1 + up
            self.n_edges += len(lat.source)
            self.n_nodes += len(lat.fan) - 1
            order = np.argsort(own[new])
            self.hashes, self.starts = np.insert(self.hashes, at[new][order], own[new][order]), np.insert(self.starts, at[new][order], begin[order])
            at = np.searchsorted(self.hashes, own)
        return self.starts[at][inverse]


def _uniform(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit hashes."""
    return ((mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _walk(lat: Lattices | Known, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path from each node to its end: (walker, edge) in walking order per walker."""
    walkers = len(node)
    who, out, step = np.flatnonzero(node != 0), [], 0
    node = node[who]
    while len(who):
        u = _uniform(seed[who] + np.uint64(step * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        edge, last = lat.first[node].copy(), lat.first[node] + lat.fan[node] - 1
        open_ = np.flatnonzero((lat.below[edge] < u) & (edge < last))
        while len(open_):
            edge[open_] += 1
            open_ = open_[(lat.below[edge[open_]] < u[open_]) & (edge[open_] < last[open_])]
        out.append((who, edge))
        node = lat.target[edge]
        live = np.flatnonzero(node)
        who, node, step = who[live], node[live], step + 1
    if not out:
        return (np.empty(0, np.int64),) * 2
    steps = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
    who, edge = (np.concatenate(x) for x in zip(*out))
    count = np.bincount(who, minlength=walkers)
    place = (np.cumsum(count) - count)[who] + steps
    in_order = np.empty_like(edge)
    in_order[place] = edge
    return np.repeat(np.arange(walkers), count), in_order


def _cut_gumbel(mass: np.ndarray, bound: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Gumbel at log mass `mass`, conditioned to lie below `bound`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = mass - np.log(np.exp(mass - bound) - np.log(_uniform(seed)))
    return np.where(np.isneginf(mass), -np.inf, np.minimum(g, bound))


class _Text:
    """Paths and open sets of one text."""

    __slots__ = ("edges", "tokens", "mass", "bounds", "offset", "taken")

    def __init__(self):
        # per path: its edges, the pre-token of each, the log-probability before each
        self.edges, self.tokens, self.mass = [], [], []
        # per path: the bounds of the sets that branch from it, the position of the first, the edges taken at each
        self.bounds, self.offset, self.taken = [], [], []


def sample_slice(lat: Lattices | Known, start_node: np.ndarray, row: np.ndarray, seeds: np.ndarray, k: int):
    """For each row: list of (edges, log p, perturbed score), and the (k+1)-th score or None.

    start_node: of each pre-token in order; row: its row; seeds: per row.
    """
    n_rows = len(seeds)
    token_at = np.searchsorted(row, np.arange(n_rows + 1))
    texts = [_Text() for _ in range(n_rows)]
    result = [[] for _ in range(n_rows)]
    kappa: list[float | None] = [None] * n_rows
    root = -np.log(-np.log(_uniform(seeds ^ np.uint64(0x5555AAAA5555AAAA))))
    # what a text walks in this round: (row, first pre-token, perturbed score, path, position, edge branched to, log-probability so far)
    todo = [(i, int(token_at[i]), float(root[i]), None, 0, -1, 0.0) for i in range(n_rows)]
    for rank in range(k):
        if not todo:
            break
        slots = np.array([t[0] for t in todo])
        own = mix(seeds[slots] + np.uint64((rank + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        # one walker per pre-token still to walk, and one for the rest of the pre-token branched in
        first = np.array([t[1] for t in todo])
        rest_node = np.array([lat.target[t[5]] if t[5] >= 0 else 0 for t in todo])
        lead = rest_node > 0
        count = token_at[slots + 1] - first + lead
        owner = np.repeat(np.arange(len(todo)), count)
        place = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + (first - lead)[owner]
        nodes = start_node[place]
        nodes[(np.cumsum(count) - count)[lead]] = rest_node[lead]
        in_row = (place - token_at[slots[owner]]).astype(np.uint64)
        who, edge = _walk(lat, nodes, own[owner] + in_row * np.uint64(0xD1B54A32D192ED03))
        slot_of, place, logq = owner[who], place[who], lat.logq[edge]
        at = np.searchsorted(slot_of, np.arange(len(todo) + 1))
        so_far, keep = np.array([t[6] for t in todo]), np.array([t[4] + (t[5] >= 0) for t in todo])
        total = np.r_[0.0, np.cumsum(logq)]
        before = total[:-1] - total[at[:-1]][slot_of] + so_far[slot_of]
        log_p = total[at[1:]] - total[at[:-1]] + so_far
        others = before + lat.rest[edge]
        position = (np.arange(len(edge)) - at[:-1][slot_of] + keep[slot_of]).astype(np.uint64)
        noise = mix(own ^ np.uint64(0x3C6EF372FE94F82B))[slot_of] + position * np.uint64(0xEB44ACCAB455D165)
        bounds = _cut_gumbel(others, np.array([t[2] for t in todo])[slot_of], noise)
        choice = _uniform(mix(own + np.uint64(7)))
        following, remaining = [], []
        ends = at.tolist()
        for slot, (i, _, g, path, branch, chosen, _) in enumerate(todo):
            t, a, b = texts[i], ends[slot], ends[slot + 1]
            edges, tokens, mass = edge[a:b], place[a:b], before[a:b]
            if path is not None:
                edges = np.concatenate([t.edges[path][:branch], [chosen], edges])
                tokens = np.concatenate([t.tokens[path][: branch + 1], tokens])
                mass = np.concatenate([t.mass[path][: branch + 1], mass])
            result[i].append((edges, float(log_p[slot]), g))
            t.edges.append(edges)
            t.tokens.append(tokens)
            t.mass.append(mass)
            t.bounds.append(bounds[a:b])
            t.offset.append(int(keep[slot]))
            t.taken.append({})
            best, where = -np.inf, None
            for s, x in enumerate(t.bounds):
                if len(x) and x[j := int(x.argmax())] > best:
                    best, where = float(x[j]), (s, j)
            if where is None:
                continue
            if rank == k - 1:
                kappa[i] = best
                continue
            s, j = where
            branch = t.offset[s] + j
            old, prefix = int(t.edges[s][branch]), float(t.mass[s][branch])
            node = lat.source[old]
            begin = int(lat.first[node])
            taken = t.taken[s].setdefault(j, {old})
            free = [e for e in range(begin, begin + int(lat.fan[node])) if e not in taken]
            q = np.exp(lat.logq[free])
            new = free[min(int(np.searchsorted(np.cumsum(q), choice[slot] * q.sum())), len(free) - 1)]
            taken.add(new)
            left = [e for e in free if e != new]
            t.bounds[s][j] = -np.inf
            if left:
                remaining.append((t.bounds[s], j, prefix + float(np.log(np.exp(lat.logq[left]).sum())), best, slot))
            following.append((i, int(t.tokens[s][branch]) + 1, best, s, branch, new, prefix + float(lat.logq[new])))
        if remaining:
            cut = _cut_gumbel(np.array([r[2] for r in remaining]), np.array([r[3] for r in remaining]), mix(own[[r[4] for r in remaining]] + np.uint64(11)))
            for (bounds, j, *_), g in zip(remaining, cut):
                bounds[j] = g
        todo = following
    return result, kappa


def sample(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 3, model: str = DEFAULT_MODEL, with_ids: bool = True) -> DataFrame:
    """Up to k rows for each row of docs, by falling perturbed score.

    key, rank (from 1), n_pieces, log_prob, perturbed, inclusion, ids_sha256
    (of the piece ids as little-endian 32-bit integers), decoded (whether the
    ids decode to the text), and with `with_ids` the ids themselves.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("seed"), F.col(text).alias("text"))
    ids_type = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("n_pieces", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.BooleanType()), *ids_type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        pieces = Pieces(v)
        lat = Known(pieces)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text"), 1 << 19):
                s, e, row, marked, h = pretokens(data, offsets)
                nodes = lat.nodes(data, s, e, marked, h)
                raw = memoryview(data)
                seeds = batch.column("seed").slice(first, end - first).to_numpy().view(np.uint64).copy()
                found, kappa = sample_slice(lat, nodes, row, mix(seeds), k)
                picked, rows = [], {f.name: [] for f in out.fields[1:] if f.name != "ids"}
                paths = [(i, rank, *path) for i, own in enumerate(found) for rank, path in enumerate(own, 1)]
                edges = np.concatenate([p[2] for p in paths]) if paths else np.empty(0, np.int64)
                ids, count = pieces.spell_out(lat.piece[edges])
                text_bytes, size = pieces.decode(ids)
                ends = np.cumsum([len(p[2]) for p in paths])
                id_end = np.r_[0, np.cumsum(count)][ends].tolist() if paths else []
                byte_end = np.r_[0, np.cumsum(size)][id_end].tolist() if paths else []
                ids, spelt, a, b = ids.astype("<i4"), memoryview(text_bytes), 0, 0
                for (i, rank, _, log_p, g), a2, b2 in zip(paths, id_end, byte_end):
                    limit = kappa[i] if kappa[i] is not None and np.isfinite(kappa[i]) else None
                    decoded = spelt[b + 1 : b2] == raw[offsets[i] : offsets[i + 1]]
                    picked.append(first + i)
                    for name, value in (("rank", rank), ("n_pieces", a2 - a), ("log_prob", log_p), ("perturbed", g), ("inclusion", 1.0 if limit is None else float(-np.expm1(-np.exp(min(700.0, log_p - limit))))), ("ids_sha256", hashlib.sha256(ids[a:a2].tobytes()).hexdigest()), ("decoded", decoded)):
                        rows[name].append(value)
                    a, b = a2, b2
                keys = batch.column("key").take(pa.array(picked, pa.int64()))
                kinds = {"rank": pa.int32(), "n_pieces": pa.int64(), "ids_sha256": pa.string()}
                columns = [keys, *(pa.array(rows[f.name], kinds.get(f.name)) for f in out.fields[1:] if f.name != "ids")]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *id_end], pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in out.fields])

    return source.mapInArrow(run, out)


def op10_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
