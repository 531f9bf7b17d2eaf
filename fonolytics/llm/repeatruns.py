"""Runs: stretches of words that repeat with a period, found from Lyndon words.

A run is a maximal stretch with smallest period q and at least two periods. By
the runs theorem every run holds a Lyndon root: a position whose longest
Lyndon word, under the order of the words or under its reverse, has length q.
So three steps find them all:

1. `lyndon_chains` is the first phase of Baier's suffix sorter. Positions are
   grouped by their first word and the groups taken from the greatest down. A
   position of the group at hand ends with its context (the words up to the
   next open position), which is its longest Lyndon word; the nearest open
   position to its left takes that context, once per member of a chain of
   equal neighbours, and moves into a new group just above its old one. Done
   for both orders of the words, this gives the Lyndon words of all positions
   without sorting suffixes.
2. A chain of equal Lyndon words is one root. Its stretch is extended to both
   sides by the longest common extension (LCE) of two positions, from prefix
   hashes by binary search, for all roots of a slice at once; each run is then
   held against the words themselves.
3. Stretches of `min_length` words or more with two periods are the runs.

A run of at least `min_length` words is covered by sequences of half that many
words that stand twice in its text. Only stretches covered so can hold a run,
so the others (most of a normal corpus) are passed over by sorted hashes; the
words of the rest are numbered exactly. No run is lost by that.

Rows are taken slice by slice in the tasks that read them: no shuffle, and
memory is bounded by a slice of texts (one whole text at least).

Results in special cases:
- a null text has no words: no runs, an empty collapsed text; so has an empty one.
- a null id stays null; repeated rows give a row each; an empty table gives an empty result.
- whole texts are searched, however long; a text may hold several runs that overlap.
- other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.textarrays import NOT_SPACE, mix, slices, text_bytes, word_hashes, word_spans

MIN_LENGTH = 12
RUNS = "array<struct<start: long, length: long, period: long>>"
# Moduli and bases of the two prefix hashes of the LCE. Found runs are checked word by word.
_MODULI = ((2147483647, 1103515245), (2147483629, 1140671485))


def lyndon_chains(words: list[int]) -> list[tuple[int, int, int]]:
    """(position, length, count) of every chain of equal, consecutive longest Lyndon words.

    `words` are numbers whose order is the words' order; a negative number ends
    the text before it. Texts end like with a word smaller than all others.
    """
    n = len(words)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    letters = sorted({w for w in words if w >= 0})
    number = {w: k for k, w in enumerate(letters)}
    group = [number.get(w, -2) for w in words]
    group.append(-2)
    members: list[list[int]] = [[] for _ in letters]
    for i, k in enumerate(group):
        if k >= 0:
            members[k].append(i)
    below, above = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    chains: list[tuple[int, int, int]] = []
    g = len(letters) - 1
    while g >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            p = before[i]
            if group[i] != g or (p >= 0 and group[p] == g):
                continue  # it has moved on, or isn't the first of its chain
            j, count = after[i], 1
            chains.append((i, j - i, 0))
            while group[j] == g:
                j = after[j]
                count += 1
            chains[-1] = (i, after[i] - i, count)
            before[j] = p
            if p >= 0 and group[p] >= 0:
                after[p] = j
                moved.setdefault((count, group[p]), []).append(p)
        # longer chains make greater contexts: they are put in first, so that shorter ones come to stand below them
        for (_, old), taken in sorted(moved.items(), key=lambda x: -x[0][0]) if len(moved) > 1 else moved.items():
            new, high = len(members), above[old]
            members.append(taken)
            below.append(old)
            above.append(high)
            above[old] = new
            if high < len(below):
                below[high] = new
            for p in taken:
                group[p] = new
        g = below[g]
    return chains


class Extensions:
    """Longest common extensions of two positions of one sequence of numbers, for many pairs at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.sums, self.powers = [], []
        for prime, base in _MODULI:
            power = np.ones(self.n + 1, np.uint64)
            done = 1
            while done < self.n + 1:  # powers by doubling
                step = min(done, self.n + 1 - done)
                power[done : done + step] = power[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                done += step
            term = (values.astype(np.int64) % prime).astype(np.uint64) * power[: self.n] % np.uint64(prime)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(term))))
            self.powers.append(power)

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for (prime, _), s, power in zip(_MODULI, self.sums, self.powers):
            m = np.uint64(prime)
            same &= (s[a + length] - s[a]) % m * power[b - a] % m == (s[b + length] - s[b]) % m
        return same

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from `a` on equal those from `b` on (a < b)."""
        return self._search(self.n - b, lambda k, most: self._equal(a[k], b[k], most))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before `a` equal those before `b` (a < b)."""
        return self._search(a.copy(), lambda k, most: self._equal(a[k] - most, b[k] - most, most))

    def _search(self, most: np.ndarray, equal) -> np.ndarray:
        found = np.zeros(len(most), np.int64)
        if not len(most):
            return found
        step = 1 << int(most.max()).bit_length()
        while step:
            k = np.flatnonzero(found + step <= most)
            ok = k[equal(k, found[k] + step)]
            found[ok] += step
            step >>= 1
        return found


def _settled(values: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch with this period around a root at [start, end), held against the words themselves."""
    n = len(values)
    off = np.flatnonzero(values[start : end - period] != values[start + period : end])
    if len(off):  # the hashes were wrong: extend the whole word at the start as far as it goes
        end = start + period + int(off[0])
    while start and values[start - 1] == values[start - 1 + period]:
        start -= 1
    while end < n and values[end] == values[end - period]:
        end += 1
    return start, end


def runs_of(values: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period.

    Negative numbers, each of which must occur once, divide the sequence.
    """
    plain = values.tolist()
    top = int(values.max(initial=0)) + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    half = -(-min_length // 2)
    probe = -(-half // 2)
    n = len(values)
    lce = None
    for words in (plain, [top - w if w >= 0 else w for w in plain]):
        chains = lyndon_chains(words)
        if not chains:
            return []
        at, period, count = np.array(chains, np.int64).T
        # beyond its root a run has max(period, min_length - period) words, so half of these on one side
        right, left = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(probe):
            b = at + period + k
            right &= (b < n) & (values[np.minimum(at + k, n - 1)] == values[np.minimum(b, n - 1)])
            a = at - 1 - k
            left &= (a >= 0) & (values[np.maximum(a, 0)] == values[np.maximum(a + period, 0)])
        keep = right | left | (count > 1)
        at, period = at[keep], period[keep]
        lce = lce or Extensions(values)
        start = at - lce.left(at, at + period)
        end = at + period + lce.right(at, at + period)
        keep = end - start >= np.maximum(min_length, 2 * period)
        found.append((np.stack((start[keep], end[keep], period[keep])), at[keep]))
    spans = np.unique(np.concatenate([f[0] for f in found], axis=1), axis=1).T.tolist()
    settled = {(*_settled(values, s, e, p), p) for s, e, p in spans}
    return sorted((s, e - s, p) for s, e, p in settled if e - s >= max(min_length, 2 * p))


def _repeated(hashes: np.ndarray, texts: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a sequence of `size` words that stands more than once in its text (`texts`: each word's text)."""
    n = len(hashes) - size + 1
    covered = np.zeros(len(hashes), bool)
    if n <= 0:
        return covered
    gram = np.zeros(n, np.uint64)
    for k in range(size):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    whole = texts[:n] == texts[size - 1 :]
    at = np.flatnonzero(whole)
    key = mix(gram[at] ^ (texts[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    change[at[again]] += 1
    change[at[again] + size] -= 1
    return np.cumsum(change[:-1]) > 0


def _slice_runs(data: np.ndarray, offsets: np.ndarray, min_length: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each text that has some, by the text's number; starts count words of the text."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    covered = _repeated(word_hashes(data, starts, ends), texts, -(-min_length // 2))
    at = np.flatnonzero(covered)
    if not len(at):
        return {}
    # the covered stretches one after the other, divided by numbers of their own
    cut = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (texts[at[1:]] != texts[at[:-1]])))
    place = np.arange(len(at)) + np.cumsum(cut)
    values = -1 - np.arange(place[-1] + 2, dtype=np.int64)
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    values[place] = [known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    origin = np.zeros(len(values), np.int64)
    origin[place] = at
    out: dict[int, list[tuple[int, int, int]]] = {}
    for s, length, p in runs_of(values, min_length):
        word = int(origin[s])
        text = int(texts[word])
        out.setdefault(text, []).append((word - int(first[text]), length, p))
    return out


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without what a run repeats after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def collapse_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, runs (start and length in words, period; by start, then period) and the collapsed text per row.

    Words are `[^\\x20\\x09-\\x0D]+`. The collapsed text has the words that no
    run repeats (each run keeps its first period), joined by one blank.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = _slice_runs(data, offsets, min_length)
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                cut = [_without_repeats(w, found[k]) if k in found else b" ".join(w) for k, w in enumerate(texts)]
                flat = [r for k in range(len(texts)) for r in found.get(k, ())]
                sizes = np.array([len(found.get(k, ())) for k in range(len(texts))], np.int64)
                runs = np.array(flat, np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), items)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists, pa.array(cut, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"]
                )

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(find, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", doc_id)
