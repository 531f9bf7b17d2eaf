"""Perplexity by an interpolated modified Kneser-Ney model of word pairs.

Tokens are the words of a text with A-Z lower-cased (runs of anything but
blanks, tabs and line ends) and one end token; the first word follows a begin
mark. The model is

    p(w|u) = (c(uw) - D(c(uw))) / c(u.) + g(u) p(w)
    p(w)   = (n(.w) - D'(n(.w))) / n(..) + g' / (V + 1)

with n(.w) the number of different words seen before w, D one of three
discounts for counts of 1, 2 and more (from the counts of counts), and g the
mass that the discounts set free. An unseen context passes on to p(w); an
unknown word keeps g' / (V + 1).

Counting is Spark's: each task sums its rows' words, then pairs, and deals the
sums to cells; a cell merges what all tasks found. Words are dealt by hash, and
pairs by a grid of both words, so a word that makes up a third of the text is
spread over a row and a column of cells, and equal pairs of a task are one
entry. The number of cells follows the amount of text. Each cell writes sorted
arrays to the shared folder: word hashes (a word's number is its place in
them), per word its statistics, pair keys and pair counts. Scoring tasks
memory-map those files and look words and pairs up by binary search; nothing of
the model passes through the driver or a broadcast but the cells' sizes.

Order 2 is what a pair of 32-bit word numbers and the disk that training may
use allow: the triples of a text are nearly all distinct, and their shuffle and
arrays together would take more than four times the input.

Results in special cases:
- a null text is an empty text: one end token.
- repeated rows count as often as they occur; ties don't arise.
- an empty training table gives p = 1 / (V + 1) = 1 for every token, score 0.
- whole texts are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.store import fresh_folder, mapped_array, put_array, written
from fonolytics.llm.textarrays import LOWER, NOT_SPACE, slices, text_bytes, word_hashes, word_spans

# Characters of text per cell: a cell merges about 4 million pairs.
CELL_CHARS = 24_000_000
# Distinct entries that a task holds before it deals them out.
HOLD = 4_000_000
END = np.uint64(0x5851F42D4C957F2D)
MAX_WORDS = 1 << 32


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end token after each, and offsets between texts."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, NOT_SPACE)
    at = before + np.arange(len(before))
    out = np.full(at[-1], END, np.uint64)
    word = np.ones(len(out), bool)
    word[at[1:] - 1] = False
    out[word] = word_hashes(data, starts, ends)
    return out, at


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at, axis=0) if len(at) else counts[:0]


def _deal(cells: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row (cell, keys, counts) per cell; keys stay sorted within."""
    order = np.argsort(cells, kind="stable")
    cells, keys, counts = cells[order], keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    spans = list(zip(at.tolist(), [*at[1:].tolist(), len(cells)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cells[at].astype(np.int32)),
            pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
        ],
        ["cell", "keys", "counts"],
    )


_DEALT = "cell int, keys binary, counts binary"


def _joined(table: pa.Table, key: str, count: str, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, key) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, count) for x in table.column("counts").to_pylist()])
    return keys, counts.astype(np.int64).reshape(-1, columns)


def _gathered(batches: Iterator[pa.RecordBatch], find, cell_of):
    """Deal out what `find(column)` returns (keys that occur), summed over as many rows as `HOLD` allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield _deal(cell_of(keys), keys, counts.astype(np.uint32))

    for batch in batches:
        for part in slices(batch, "text"):
            keys = find(part.column("text"))
            held.append(_summed(keys, np.ones(len(keys), np.int64)))
            size += len(held[-1][0])
            if size > HOLD:
                yield from out()
                held, size = [], 0
    yield from out()


@dataclass
class Model:
    """Where the arrays lie, and the numbers that all tasks need."""

    folder: str
    cells: int
    grid: int
    before: list[int]  # words in the cells before each
    tokens: int = 0
    pair_cells: list[int] = field(default_factory=list)  # cells that have pairs
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pairs: int = 0
    word_rest: float = 1.0  # g'

    @property
    def words(self) -> int:
        return self.before[-1]

    # What a worker has mapped; not part of what is sent to it.
    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_mapped"}

    def array(self, name: str, dtype: str) -> np.ndarray:
        mapped = self.__dict__.setdefault("_mapped", {})
        if name not in mapped:
            mapped[name] = mapped_array(f"{self.folder}/{name}", dtype)
        return mapped[name]

    def word_cell(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.cells) >> np.uint64(32)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted word hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        cell = self.word_cell(hashes)
        for c in np.unique(cell).tolist():
            if self.before[c + 1] > self.before[c]:
                a, b = np.searchsorted(cell, [c, c + 1])
                known = self.array(f"words-{c}", "u8")
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.before[c], -1)
        return out

    def of_words(self, numbers: np.ndarray, name: str, columns: int = 1) -> np.ndarray:
        """Rows of a per-word array for sorted numbers (0 for -1)."""
        out = np.zeros((len(numbers), columns), np.int64)
        cell = np.searchsorted(self.before, numbers, "right") - 1
        for c in np.unique(cell[numbers >= 0]).tolist():
            a, b = np.searchsorted(cell, [c, c + 1])
            own = self.array(f"{name}-{c}", "u8").reshape(-1, columns)
            out[a:b] = own[numbers[a:b] - self.before[c]]
        return out

    def pair_cell(self, keys: np.ndarray) -> np.ndarray:
        n = np.uint64(max(1, self.words + 1))
        row, column = (keys >> np.uint64(32)) * np.uint64(self.grid) // n, (keys & np.uint64(MAX_WORDS - 1)) * np.uint64(self.grid) // n
        return (row * np.uint64(self.grid) + column).astype(np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        cell = self.pair_cell(keys)
        order = np.argsort(cell, kind="stable")
        edges = np.searchsorted(cell[order], np.arange(self.grid**2 + 1))
        for c in self.pair_cells:
            at = order[edges[c] : edges[c + 1]]
            if len(at):
                known = self.array(f"pairs-{c}", "u8")
                place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                out[at] = np.where(known[place] == keys[at], self.array(f"paircounts-{c}", "u4")[place], 0)
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D for counts of 1, 2, and more, from how many counts are 1, 2, 3 and 4; within [0, count]."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == i).sum()) for i in (1, 2, 3, 4)] + [int((x >= 3).sum())]


def train(docs: DataFrame, text: str = "text", cell_chars: int = CELL_CHARS) -> Model:
    """Count all rows of `docs` and write the model's arrays to a folder of its own under the shared checkpoint folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    grid = max(2, math.isqrt(max(0, chars // cell_chars)) + 1)
    model = Model(fresh_folder(spark, "kneser-ney"), grid**2, grid, [])
    folder = model.folder

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, lambda col: token_hashes(col)[0], model.word_cell)

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        hashes, counts = _summed(*_joined(table, "u8", "u4"))
        put_array(f"{folder}/words-{cell}", hashes)
        put_array(f"{folder}/counts-{cell}", counts.astype(np.uint64))
        return pa.table({"cell": pa.array([cell], pa.int32()), "words": [len(hashes)], "tokens": [int(counts.sum())]})

    dealt = rows.mapInArrow(words, _DEALT)
    sizes = {r.cell: r for r in dealt.groupBy("cell").applyInArrow(merge_words, "cell int, words long, tokens long").collect()}
    model.before = np.concatenate(([0], np.cumsum([sizes[c].words if c in sizes else 0 for c in range(model.cells)]))).tolist()
    model.tokens = sum(r.tokens for r in sizes.values())
    if model.words >= MAX_WORDS - 1:
        raise ValueError(f"more than {MAX_WORDS - 2} distinct words")
    if not model.words:
        return model

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, lambda col: _pair_keys(model, *token_hashes(col))[0], model.pair_cell)

    def merge_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Write the cell's pairs; deal the words' shares of it: number of words before, and after it by count."""
        cell = key[0].as_py()
        keys, counts = _summed(*_joined(table, "u8", "u4"))
        counts = counts[:, 0]
        put_array(f"{folder}/pairs-{cell}", keys)
        put_array(f"{folder}/paircounts-{cell}", counts.astype(np.uint32))
        w, u = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(MAX_WORDS - 1)).astype(np.int64)
        rows = np.zeros((2 * len(keys), 4), np.int64)
        rows[: len(keys), 0] = 1
        rows[np.arange(len(keys)) + len(keys), np.minimum(counts, 3)] = 1
        who, sums = _summed(np.concatenate((w, u)), rows)
        shares = _deal(np.minimum(np.searchsorted(model.before, who, "right") - 1, model.cells - 1), who.astype(np.uint32), sums.astype(np.uint32))
        n = shares.num_rows
        found = pa.table({"cell": pa.array([cell] * n, pa.int32()), "stats": pa.array([_counts_of_counts(counts)] * n, pa.list_(pa.int64()))})
        return found.append_column("word_cell", shares.column(0)).append_column("keys", shares.column(1)).append_column("counts", shares.column(2))

    def merge_shares(key: tuple, table: pa.Table) -> pa.Table:
        """Write the statistics of a cell of words (the begin mark's number comes after the last word)."""
        cell = key[0].as_py()
        who, sums = _summed(*_joined(table, "u4", "u4", 4))
        last = cell == model.cells - 1
        own = np.zeros((model.before[cell + 1] - model.before[cell] + last, 4), np.uint64)
        own[who.astype(np.int64) - model.before[cell]] = sums
        put_array(f"{folder}/stats-{cell}", own)
        before = own[: len(own) - last, 0]
        return pa.table({"cell": pa.array([cell], pa.int32()), "stats": [_counts_of_counts(before) + [int(before.sum())]]})

    # written, so that the pairs are counted and their files made once
    shares = written(
        rows.mapInArrow(pairs, _DEALT).groupBy("cell").applyInArrow(merge_pairs, "cell int, stats array<long>, word_cell int, keys binary, counts binary"),
        "pair-shares",
    )
    by_cell = shares.groupBy("cell").agg(F.first("stats").alias("stats")).collect()
    model.pair_cells = sorted(r.cell for r in by_cell)
    totals = np.sum([r.stats for r in by_cell], axis=0).tolist()
    model.pair_discounts = _discounts(totals[:4])
    own = shares.select(F.col("word_cell").alias("cell"), "keys", "counts")
    stats = np.sum([r.stats for r in own.groupBy("cell").applyInArrow(merge_shares, "cell int, stats array<long>").collect()], axis=0).tolist()
    model.word_discounts = _discounts(stats[:4])
    model.pairs = stats[5]
    model.word_rest = sum(d * n for d, n in zip(model.word_discounts, (stats[0], stats[1], stats[4]))) / model.pairs
    return model


def _pair_keys(model: Model, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: key of the pair it ends, its own number, its predecessor's number (the begin mark is number V; -1 unknown)."""
    uniq, back = np.unique(hashes, return_inverse=True)
    number = model.numbers(uniq)[back]
    prior = np.empty_like(number)
    prior[1:] = number[:-1]
    prior[offsets[:-1]] = model.words
    return (number.astype(np.uint64) << np.uint64(32)) | (prior.astype(np.uint64) & np.uint64(MAX_WORDS - 1)), number, prior


def _discount(x: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(x, 3)]


def _score_batch(model: Model, part: pa.RecordBatch) -> pa.RecordBatch:
    hashes, offsets = token_hashes(part.column("text"))
    if model.words:
        keys, number, prior = _pair_keys(model, hashes, offsets)
        uniq, back = np.unique(number, return_inverse=True)
        count = model.of_words(uniq, "counts")[back, 0]
        before = model.of_words(uniq, "stats", 4)[back, 0]
        p = (before - _discount(before, model.word_discounts)) / model.pairs + model.word_rest / (model.words + 1)
        contexts, at = np.unique(prior, return_inverse=True)
        stats = model.of_words(np.minimum(contexts, model.words - 1), "stats", 4)
        total = model.of_words(np.minimum(contexts, model.words - 1), "counts")[:, 0]
        if contexts[-1] == model.words:  # the begin mark: its statistics end the last cell, and it stands before every text
            stats[-1] = model.array(f"stats-{model.cells - 1}", "u8")[-4:]
            total[-1] = model.of_words(model.numbers(np.array([END])), "counts")[0, 0]
        total, after = total[at], stats[at, 1:]
        known = (number >= 0) & (prior >= 0)
        pairs, spot = np.unique(keys[known], return_inverse=True)
        c = np.zeros(len(keys), np.int64)
        c[known] = model.pair_counts(pairs)[spot]
        seen = total > 0
        q = (c - _discount(c, model.pair_discounts) + after @ np.array(model.pair_discounts) * p) / np.maximum(total, 1)
        p = np.where(seen, q, p)
    else:
        count, p = np.zeros(len(hashes), np.int64), np.ones(len(hashes))
    add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  each text has a token
    base = np.log10((count + 1) / (model.tokens + model.words + 1))
    return pa.RecordBatch.from_arrays(
        [part.column("id"), pa.array(np.diff(offsets)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))],
        ["id", "n_tokens", "n_known", "base_score", "score"],
    )


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score (add-one, single words), score (log10 of the text's probability), perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _score_batch(model, part)

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    found = own.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select(
        F.col("id").alias(doc_id),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
