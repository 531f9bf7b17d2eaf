"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of `window` consecutive words of the benchmark
items; an item of fewer words is one window of its own length. Patterns of one
length m share a shift table over blocks of two words: it says how far the
search may jump because no pattern of the group has the block that ends at the
present word nearer to its own end. Where the table says 0, the block's
suffix-hash bucket names the patterns that end with it, and those are compared
with the text word by word, then byte by byte. Most words are never looked at.

The words are runs of ASCII letters, digits and characters above 0x7F in the
text with A-Z lower-cased.

Results in special cases:
- null or empty text, or one without words: no words, no hits.
- an item without words is never found; an item with a null id marks the words
  that it hits, but isn't in the list of items.
- repeated rows are searched one by one and get equal results; items with the
  same id, or the same text, each count by their id.
- an empty benchmark finds nothing; an empty table gives an empty result.

Every task searches its own rows; nothing is shuffled. The benchmark's texts
go to every task, so a benchmark of more than `MAX_BYTES` is searched in parts of
at most that size (an item that is larger by itself is a part of its own): the
documents are written once with a row number, searched once per part, and the
parts' hits, narrow rows, are joined per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.store import frugal, written
from fonolytics.llm.textarrays import ALNUM, LOWER, mix, ranges, slices, text_bytes, word_hashes, word_spans

WINDOW = 10
MAX_BYTES = 8 << 20
TABLE_BITS = 18
# Window ends that one cursor walks over; the cursors of a batch move together.
STRIDE = 128
_TURN = np.uint64(0x9FB21C651E98DF25)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, ALNUM)
    return data, starts, ends, before


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))


class Patterns:
    """The patterns of one length: shift table, suffix buckets, and the items of each pattern."""

    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: list[np.ndarray]):
        self.m = m = hashes.shape[1]
        self.block = min(2, m)
        last = self.blocks(hashes[:, m - 1], hashes[:, m - 2] if m > 1 else None)
        order = np.argsort(last, kind="stable")
        self.hashes, self.last = hashes[order], last[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.int64)
        for j in range(self.block, m + 1):
            found = self.blocks(hashes[:, j - 1], hashes[:, j - 2] if m > 1 else None)
            np.minimum.at(self.shift, self.slot(found), m - j)

    @staticmethod
    def blocks(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        return mix(last if before is None else last + before * _TURN)

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end of the occurrence, pattern) of all occurrences by word hash; `before` bounds the texts."""
        m, lo, hi = self.m, before[:-1] + self.m, before[1:]
        n = np.maximum(0, (hi - lo + STRIDE) // STRIDE)
        at = np.repeat(lo, n) + ranges(np.zeros_like(n), n) * STRIDE
        stop = np.minimum(at + STRIDE - 1, np.repeat(hi, n))
        ends, blocks = [], []
        while len(at):
            block = self.blocks(words[at - 1], words[at - 2] if m > 1 else None)
            jump = self.shift[self.slot(block)]
            here = jump == 0
            if here.any():
                ends.append(at[here])
                blocks.append(block[here])
            at = at + np.maximum(jump, 1)
            on = at <= stop
            at, stop = at[on], stop[on]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, block = np.concatenate(ends), np.concatenate(blocks)
        first = np.searchsorted(self.last, block, "left")
        size = np.searchsorted(self.last, block, "right") - first
        pattern, end = ranges(first, size), np.repeat(end, size)
        for j in range(m):  # the first word first: it differs most often
            same = words[end - m + j] == self.hashes[pattern, j]
            pattern, end = pattern[same], end[same]
        return end, pattern


def _patterns(item_texts: list[str], window: int) -> list[Patterns]:
    data, starts, ends, before = _words(pa.array(item_texts, pa.string()))
    hashes = word_hashes(data, starts, ends)
    found: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for item, (a, b) in enumerate(zip(before.tolist(), before[1:].tolist())):
        m = min(window, b - a)
        for s in range(a, b - m + 1 if m else a):
            key = _text(data, starts[s : s + m], ends[s : s + m])
            found.setdefault(m, {}).setdefault(key, (hashes[s : s + m], []))[1].append(item)
    return [
        Patterns(np.stack([h for h, _ in group.values()]), list(group), [np.unique(i) for _, i in group.values()])
        for _, group in sorted(found.items())
    ]


def _scan_batch(batch: pa.RecordBatch, groups: list[Patterns], ids: list[str | None]) -> pa.RecordBatch:
    data, starts, ends, before = _words(batch.column(1))
    words = word_hashes(data, starts, ends)
    edge = np.zeros(len(words) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for g in groups:
        end, pattern = g.search(words, before)
        exact = [
            _text(data, starts[e - g.m : e], ends[e - g.m : e]) == g.texts[p] for e, p in zip(end.tolist(), pattern.tolist())
        ]
        end, pattern = end[exact], pattern[exact]
        np.add.at(edge, end - g.m, 1)
        np.add.at(edge, end, -1)
        doc = np.searchsorted(before, end - 1, "right") - 1
        n = np.array([len(g.items[p]) for p in pattern.tolist()], np.int64)
        if len(n):
            pairs.append(np.unique(np.stack((np.repeat(doc, n), np.concatenate([g.items[p] for p in pattern.tolist()])), 1), axis=0))
    hit = np.cumsum(edge[:-1]) > 0
    first = hit.copy()
    first[1:] &= ~hit[:-1]
    at = before[:-1][before[:-1] < len(hit)]
    first[at] = hit[at]
    last = hit.copy()
    last[:-1] &= ~hit[1:]
    at = before[1:][before[1:] > 0] - 1
    last[at] = hit[at]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_doc = np.searchsorted(a, before)
    base = np.repeat(before[:-1], np.diff(per_doc))
    spans = pa.ListArray.from_arrays(
        pa.array(per_doc, pa.int32()), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], ["first", "after"])
    )
    items: list[list[str]] = [[] for _ in range(batch.num_rows)]
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        if ids[i] is not None:
            items[d].append(ids[i])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.diff(before)), spans, pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
        ["id", "n_words", "spans", "items"],
    )


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: its id, n_words, spans (hit words as [first, after), from 0) and items (found ids as sorted strings)."""
    bench = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    if _size(bench) <= MAX_BYTES:
        found = _find(own, [(r.id, r.text) for r in bench.collect() if r.text], window)
        return found.withColumnRenamed("id", doc_id)
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "searched")
    search = own.select(F.col("row").alias("id"), "text")
    parts = [written(_find(search, part, window), "hits") for part in _parts(bench)]
    hits = reduce(DataFrame.unionByName, [p.where(F.size("spans") > 0) for p in parts])
    hits = hits.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select(F.col("id").alias("row"), _union(F.array_sort("spans")).alias("spans"), "items")
    sizes = parts[0].select(F.col("id").alias("row"), "n_words", F.filter("spans", lambda s: F.lit(False)).alias("none"))
    found = own.select("row", "id").join(sizes, "row").join(hits, "row", "left")
    return found.select(F.col("id").alias(doc_id), "n_words", F.coalesce("spans", "none").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _size(bench: DataFrame) -> int:
    return bench.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0


def _parts(bench: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The items (id, text) in parts of at most `MAX_BYTES`; the driver holds one at a time."""
    part, size = [], 0
    for r in written(bench, "benchmark").toLocalIterator():
        if not r.text:
            continue
        own = len(r.text.encode()) + 32
        if part and size + own > MAX_BYTES:
            yield part
            part, size = [], 0
        part.append((r.id, r.text))
        size += own
    yield part


def _union(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap as one."""
    last = lambda found: F.element_at(found, -1)
    longer = lambda found, s: F.struct(last(found)["first"].alias("first"), F.greatest(last(found)["after"], s["after"]).alias("after"))
    return F.aggregate(
        spans,
        F.slice(spans, 1, 1),
        lambda found, s: F.when(s["first"] <= last(found)["after"], F.concat(F.slice(found, 1, F.size(found) - 1), F.array(longer(found, s)))).otherwise(
            F.concat(found, F.array(s))
        ),
    )


def _find(own: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """Per row of `own` (id, text): id, n_words, spans and items."""
    ids, texts = [i for i, _ in items], [t for _, t in items]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _patterns(texts, window)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _scan_batch(part, groups, ids)

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(frugal(scan), f"id {kind}, n_words long, spans array<struct<first: long, after: long>>, items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark window."""
    bench = benchmark.select("text").where("text is not null")
    if _size(bench) > MAX_BYTES:
        rows = written(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "searched")
        search = rows.select(F.col("row").alias("id"), F.col("doc")[text].cast("string").alias("text"))
        bench = bench.select(F.lit(None).cast("string").alias("id"), F.col("text").cast("string").alias("text"))
        hits = [written(_find(search, part, window).where(F.size("spans") > 0).select(F.col("id").alias("row")), "hits") for part in _parts(bench)]
        return rows.join(reduce(DataFrame.unionByName, hits), "row", "left_anti").select("doc.*")
    texts = [r.text for r in bench.collect()]
    made: list[list[Patterns]] = []

    @F.arrow_udf("boolean")
    def clean(col: pa.Array) -> pa.Array:
        if not made:
            made.append(_patterns(texts, window))
        batch = pa.RecordBatch.from_arrays([col, col], ["id", "text"])
        parts = [_scan_batch(p, made[0], [""] * len(texts)).column("spans").value_lengths() for p in slices(batch, "text")]
        return pa.compute.equal(pa.chunked_array(parts, pa.int32()).combine_chunks(), 0) if parts else pa.array([], pa.bool_())

    return docs.where(clean(F.col(text).cast("string")))
