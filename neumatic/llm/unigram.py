"""Unigram view of a public SentencePiece vocabulary, and the pre-tokens of texts.

The vocabulary file is only read (its path is a parameter) and nothing is
trained: a piece of merge rank r gets the log-probability of Zipf's law,
-ln(r + 10) up to the constant that makes the pieces sum to one. Characters
that are no piece of their own fall back to their UTF-8 bytes.

A pre-token is a run of bytes that are not ASCII white space, with the one
space before it (the mark "▁"), or any other single white-space byte. A text
starts with one extra mark, which decoding drops, so decode(encode(x)) == x
for every text. A literal "▁" in a text is spelt in bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._text import SPACE, Prefix, words

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """piece -> (id, log-probability); log-probability and ids of the byte pieces; bytes of each id."""

    pieces: dict[str, tuple[int, float]]
    byte_score: float
    byte_ids: tuple[int, ...]
    spelling: tuple[bytes, ...]
    longest: int

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        weight = {i: 1.0 / (10 - model.get_score(i)) for i in plain}
        total = float(sum(weight.values()))
        pieces = {model.id_to_piece(i): (i, float(np.log(weight[i] / total))) for i in plain}
        lowest = min(s for _, s in pieces.values())
        byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        spelling = [b""] * n
        for piece, (i, _) in pieces.items():
            spelling[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            spelling[i] = bytes([b])
        return cls(pieces, lowest - 2.0, byte_ids, tuple(spelling), max(map(len, pieces)))

    def spelt(self, word: str, marked: bool) -> str:
        """A pre-token as looked up in the pieces; a literal mark becomes a character of equal UTF-8 length that is in no piece."""
        return (MARK if marked else "") + word.replace(MARK, "\uffff")

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of piece ids: their bytes without the extra first mark."""
        return b"".join(map(self.spelling.__getitem__, ids))[1:]


def pretokens(data: np.ndarray, offsets: np.ndarray):
    """start, end, row, marked, hash of the pre-tokens in order.

    An extra mark before a text that begins with white space is a pre-token of
    no bytes at the text's start.
    """
    start, end, row = words(data, offsets)
    at_start = start == offsets[row]
    before = np.maximum(start - 1, 0)
    spaced = ~at_start & (data[before] == 0x20) if len(data) else at_start
    lone = SPACE[data]
    lone[before[spaced]] = False
    lone = np.flatnonzero(lone)
    lone_row = np.searchsorted(offsets, lone, "right") - 1
    texts = np.flatnonzero(np.diff(offsets) > 0)
    extra = texts[SPACE[data[offsets[texts]]]] if len(data) else texts
    s = np.concatenate([start, lone, offsets[extra]])
    e = np.concatenate([end, lone + 1, offsets[extra]])
    r = np.concatenate([row, lone_row, extra])
    m = np.concatenate([at_start | spaced, np.zeros(len(lone), bool), np.ones(len(extra), bool)])
    order = np.lexsort((e, s, r))
    s, e, r, m = s[order], e[order], r[order], m[order]
    h = Prefix(data).span(s, e) ^ (m.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return s, e, r, m, h
