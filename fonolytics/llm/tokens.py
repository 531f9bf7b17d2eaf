"""Byte-level BPE token ids of whole texts, batch by batch.

A byte-level BPE never merges across the pieces that its pre-tokenizer cuts
(letters, digits, other signs, white space), and most pieces of a corpus recur.
So the pieces of a batch are found with array operations, and the tokenizer
itself encodes each distinct piece once; a worker keeps the ids of the pieces
it has seen, up to `KEEP` of them.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from fonolytics.llm.textarrays import ranges, word_hashes

KEEP = 600_000
SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASS = np.zeros(0, np.uint8)


def _classes() -> np.ndarray:
    """Class of every code point: white space, \\p{L}, \\p{N}, or another."""
    global _CLASS
    if not len(_CLASS):
        from unicodedata import category

        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        # The code points with the Unicode property White_Space.
        white = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[white] = SPACE
        _CLASS = table
    return _CLASS


def piece_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin in concatenated texts (`offsets` between them).

    A piece is a run of one class. One blank before a run of letters, digits or
    other signs belongs to that run; of white space before such a run, the last
    character stands alone otherwise. After a letter, digit or line's start, the
    signs 's 't 're 've 'm 'll 'd are a piece of their own.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    begin = np.zeros(n + 1, bool)
    begin[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin |= edge
    begin[n] = True
    run = np.flatnonzero(begin[:n])
    # runs that follow white space of the same text
    after = run[(run > 0) & (kind[run] != SPACE) & ~edge[run]]
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True  # the last white space leaves its run
    blank = after[codes[after - 1] == 0x20]
    begin[blank] = False  # and opens the next piece if it is a blank
    sign = run[(codes[run] == 0x27) & begin[run]]
    sign = sign[(sign + 1 < n)]
    sign = sign[begin[sign + 1] & ~edge[sign + 1] & (kind[sign + 1] == LETTER)]
    if len(sign):
        one = codes[sign + 1]
        inside = (sign + 2 < n) & ~edge[np.minimum(sign + 2, n)]
        two = np.where(inside, codes[np.minimum(sign + 2, n - 1)], 0)
        pair = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        begin[sign[pair | short] + 1] = False
        begin[sign[short] + 2] = True
        begin[sign[pair] + 3] = True
    return np.flatnonzero(begin[:n])


class PieceEncoder:
    _made: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("an added token that depends on what stands around it")
        # as the library does by default, their strings are these tokens wherever they stand in a text
        self.added = sorted((t.content for t in added), key=len, reverse=True)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; with the place and number of each piece's ids in the pool
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        if self.used + len(new) > len(self.pool):
            grown = np.zeros(2 * (self.used + len(new)), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(new)] = new
        place = self.used + np.cumsum(count) - count
        self.used += len(new)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.place = np.insert(self.place, at, place)
        self.count = np.insert(self.count, at, count)

    def _added_spans(self, texts: list[str], offsets: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of every added token in the texts, as places in all of them."""
        pattern = re.compile("|".join(map(re.escape, self.added)))
        return [(m.start() + a, m.end() + a) for t, a in zip(texts, offsets.tolist()) for m in pattern.finditer(t)]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an `end` after each, and the offsets between texts; a null is an empty text."""
        texts = [t or "" for t in column.to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        spans = self._added_spans(texts, offsets) if any(t in whole for t in self.added) else []
        starts = piece_starts(codes, np.unique(np.concatenate((offsets, *spans))) if spans else offsets)
        if spans:  # an added token is one piece
            begin, end_of = np.array(spans).T
            k = np.searchsorted(begin, starts, "right") - 1
            starts = starts[(k < 0) | (starts == begin[k]) | (starts >= end_of[k])]
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        uniq, first, back = np.unique(word_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        if len(uniq):
            at = np.minimum(np.searchsorted(self.hashes, uniq), max(len(self.hashes) - 1, 0))
            new = self.hashes[at] != uniq if len(self.hashes) else np.ones(len(uniq), bool)
            if len(self.hashes) + int(new.sum()) > KEEP:
                self._forget()
                new[:] = True
            if new.any():
                self._learn(uniq[new], [whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
                at = np.searchsorted(self.hashes, uniq)
            count, place = self.count[at][back], self.place[at][back]
        else:
            count = place = np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(count)))
        doc_ids = before[np.searchsorted(starts, offsets)] + np.arange(len(offsets))
        out = np.full(doc_ids[-1], end, np.uint32)
        spot = np.ones(len(out), bool)
        spot[doc_ids[1:] - 1] = False
        out[spot] = self.pool[ranges(place, count)]
        return out, doc_ids
