"""Phrases that are like earlier ones, compared only where that is possible."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from neumatic.operators import sequences


def test_phrases_are_compared_only_where_their_letters_allow_it(monkeypatch):
    rng = random.Random(5)
    words = ["ca", "lên", "đi", "biển", "x" * 40, "thương", "\U0001d11e"]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    phrases += [p[: len(p) // 2] + "z" + p[len(p) // 2 + 1 :] for p in phrases[:20]]
    left, right = (x.ravel() for x in np.meshgrid(*[np.arange(len(phrases))] * 2))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], 0) for j in range(len(b))] if not b else _step(row, x, b)
        return row[-1]

    def _step(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    fold = lambda s: "".join(chr(ord(c) % 64) for c in s)
    some = np.random.default_rng(1).integers(0, len(left), 300)
    assert sequences.common_bounds(phrases, phrases, left, right)[some].tolist() == [common(fold(phrases[left[k]]), fold(phrases[right[k]])) for k in some]
    solved = []
    ratios = sequences.block_ratios
    monkeypatch.setattr(sequences, "block_ratios", lambda a, b: solved.append(len(a)) or ratios(a, b))
    got = sequences._alike(phrases, left, right, 0.85)
    assert got.tolist() == [SequenceMatcher(None, phrases[i], phrases[j], autojunk=False).ratio() > 0.85 for i, j in zip(left, right)]
    assert sum(solved) < len(left) / 4
    monkeypatch.setattr(sequences, "_BOUNDED", 10)
    assert sequences._alike(phrases, left, right, 0.85).tolist() == got.tolist()


def test_repeated_phrases_on_odd_frames(spark):
    rows = [(1, 0, "ca lên đi", 1), (1, 1, None, 1), (1, 2, "ca lên đi", 1), (1, 2, "ca lên đi", None), (None, 0, "x", 1), (None, 1, "x", 1), (2, None, "x", 1), (2, 1, "x", 1), (3, 0, "", 1), (3, 1, "", 1), (4, 0, "y", 2), (4, 1, "y", 2)]
    frames = spark.createDataFrame(rows, "s long, page long, phrase string, rows int")
    assert [tuple(r) for r in sequences.repeated_phrases(frames, ["s"], "page", "phrase", F.col("rows") == 1).collect()] == [(1, 2)]


def test_neighbours_are_compared_once_for_each_pair(spark, monkeypatch):
    import random

    import pyarrow as pa

    from neumatic.operators import sequences

    rng = random.Random(8)
    words = ["", "a", "ab", "abc", "xabcx", "a\U0001f3b5b", "é", "a" * 200, "ba" * 90]
    texts = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(60)] + [(60, None)]
    frame = spark.createDataFrame(texts, "i long, w array<string>").coalesce(1)
    plain = lambda a, b: float(sequences.block_ratios([a], [b])[0])
    want = {i: [plain(a, b) for a, b in zip(w or [], (w or [])[1:])] for i, w in texts}
    assert {r["i"]: r["ratios"] for r in sequences.neighbour_ratios(frame, "w").collect()} == want
    # some texts at a time, and long strings without a table of all their letters
    monkeypatch.setattr(sequences, "_WORDS", 20)
    monkeypatch.setattr(sequences, "_TABLE", 3)
    asked = []
    solve = sequences.block_ratios
    monkeypatch.setattr(sequences, "block_ratios", lambda a, b: asked.append(len(set(zip(a, b))) == len(a)) or solve(a, b))
    grabbed = {}
    held = type("Texts", (), {"columns": ["i", "w"], "schema": frame.schema, "mapInArrow": lambda self, f, schema: grabbed.update(run=f)})()
    sequences.neighbour_ratios(held, "w")
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts], pa.int64()), pa.array([t[1] for t in texts], pa.list_(pa.string()))], ["i", "w"])
    out = list(grabbed["run"](iter([batch, batch.slice(0, 0)])))
    assert len(out) > 5 and all(asked) and {i: r for b in out for i, r in zip(b["i"].to_pylist(), b["ratios"].to_pylist())} == want
