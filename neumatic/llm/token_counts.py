"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A text's tokens are the pieces of the most probable segmentation of its
pre-tokens under a unigram vocabulary. A task inserts the distinct pre-tokens
it meets in a trie. The best forward score and the number of pieces that
reach it depend on the prefix only, so they are computed once per trie node,
whatever the number of pre-tokens and texts that share it; the count at a
pre-token's last node is stored and texts add up stored counts. Ties go to
the segmentation with fewer pieces.

Nothing is shuffled: texts stay where they are read. The trie is emptied when
it has `max_nodes` nodes and then grows again, so memory is bounded and the
counts are the same. Symbols beyond `max_depth` continue from the node reached
with a score window of the longest piece and store nothing.

Defined results: null and empty texts have no pre-tokens and no tokens; extra
columns pass through (a column named as a result is replaced).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import small_batches
from ._text import distinct, slices
from .unigram import DEFAULT_MODEL, MARK, Vocabulary, pretokens


class Trie:
    """Forward scores and piece counts of all prefixes of the inserted pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, max_nodes: int, max_depth: int):
        self.v, self.max_nodes, self.max_depth = vocabulary, max_nodes, max_depth
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("l", [0])
        self.terminal: dict[int, int] = {}

    def _best(self, word: str, d: int, score: list[float], count: list[int], base: int) -> tuple[float, int]:
        """Best (score, count) of the first d symbols, given those of shorter prefixes (score[i - base])."""
        get, best, fewest = self.v.pieces.get, -1e300, 0
        for i in range(max(0, d - self.v.longest), d):
            found = get(word[i:d])
            if found is not None:
                s = score[i - base] + found[1]
                if s > best or s == best and count[i - base] + 1 < fewest:
                    best, fewest = s, count[i - base] + 1
        last = word[d - 1]
        if last not in self.v.pieces:
            size = len(last.encode())
            s = score[d - 1 - base] + size * self.v.byte_score
            if s > best:
                best, fewest = s, count[d - 1 - base] + size
        return best, fewest

    def insert(self, word: str) -> int:
        """Number of pieces of the best segmentation."""
        node, score, count, child = 0, [0.0], [0], self.child
        depth = min(len(word), self.max_depth)
        for d in range(1, depth + 1):
            key = node << 21 | ord(word[d - 1])
            node = child.get(key, -1)
            if node < 0:
                s, c = self._best(word, d, score, count, 0)
                node = child[key] = len(self.score)
                self.score.append(s)
                self.count.append(c)
            else:
                s, c = self.score[node], self.count[node]
            score.append(s)
            count.append(c)
        base = 0
        for d in range(depth + 1, len(word) + 1):
            s, c = self._best(word, d, score, count, base)
            score.append(s)
            count.append(c)
            if len(score) > 4 * self.v.longest + 64:
                drop = len(score) - self.v.longest - 1
                base += drop
                del score[:drop], count[:drop]
        return count[-1]


def count_tokens(docs: DataFrame, *, text: str = "text", model: str = DEFAULT_MODEL, max_nodes: int = 1_000_000, max_depth: int = 64) -> DataFrame:
    """docs without its text, with n_pretokens and n_tokens added."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "n_pretokens", "n_tokens")]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value, max_nodes, max_depth)
        for batch in batches:
            total, pre = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, end, data, offsets in slices(batch.column(len(names))):
                s, e, row, marked, h = pretokens(data, offsets)
                lead, inverse = distinct(h)
                unique = h[lead]
                known, raw = trie.terminal, memoryview(data)
                counts = np.empty(len(unique), np.int64)
                for i, (key, at) in enumerate(zip(unique.tolist(), lead.tolist())):
                    c = known.get(key)
                    if c is None:
                        word = bytes(raw[s[at] : e[at]]).decode()
                        c = known[key] = trie.insert(MARK if word == " " else trie.v.spelt(word, bool(marked[at])))
                        if len(trie.score) > max_nodes or len(known) > max_nodes:
                            trie.clear()
                            known = trie.terminal
                    counts[i] = c
                pre[first:end] = np.bincount(row, minlength=end - first)
                total[first:end] = np.bincount(row, weights=counts[inverse], minlength=end - first)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(pre), pa.array(total)], [*names, "n_pretokens", "n_tokens"])

    out = T.StructType([*rest, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*names, text).mapInArrow(run, out)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
