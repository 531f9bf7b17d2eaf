"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is the weighted set of its shingles of `SHINGLE` words (lower-cased
runs of letters and digits; a text of fewer words is one shingle). Darts are
thrown at each shingle's region, weight by rank, by a hash of the shingle and
the region's cell: the same shingle receives the same darts in every document.
A document keeps the darts that land under its shingles' weights and below a
rank that lets about k ln k + 2k of them pass, and per coordinate (a dart names
one of k) the earliest. Where a coordinate stays empty, the rank is doubled.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. The work per document is its shingles plus k ln k darts.

`BANDS` bands of `ROWS` coordinates are the join keys (a pair of similarity 0.8
is missed with probability 0.00003). Documents with equal shingle sets are one
node from the start. A bucket never makes all its pairs: each member is held
against the bucket's hub (the node with the most bucket mates), and members that
it didn't take against a second hub. Members of buckets that then still hold
several components go through an exact similarity join: what a text shares with no
other component is of no use to a link, so who has less than the threshold's part
left is out, until few more fall out; the rest meets by its rarest shingles, under
bounds by size and by what follows the match. These bounds lose no link. Every
link is decided by the exact similarity of the shingle sets. Classes are the
components.

Results in special cases:
- a text without words (null, empty, signs only) is alone in its class.
- texts with equal shingles are one class; ties between hubs go to the larger
  node number; the class id is the smallest id of the class (nulls last).
- repeated rows are rows of the same class; a null id is kept.
- an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonolytics.llm.components import components
from fonolytics.llm.store import frugal, written
from fonolytics.llm.textarrays import ALNUM, LOWER, mix, ranges, slices, text_bytes, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 7, 45
# Shingles and darts of texts that are worked on at a time.
DARTS = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xA0761D6478BD642F)
# Probability that a cell of unit area has at most 0, 1, 2, ... darts (Poisson, mean 1).
_AT_MOST = np.cumsum(np.exp(-1) / np.concatenate(([1.0], np.cumprod(np.arange(1.0, 20.0)))))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (sorted in each), how often each occurs, and offsets between texts."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    size = np.diff(before)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    first = ranges(before[:-1], count)
    last = np.repeat(before[1:], count)
    hashes = np.zeros(len(first), np.uint64)
    for j in range(n):
        inside = first + j < last
        hashes = np.where(inside, mix(hashes * _TURN + words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else hashes), hashes)
    doc = np.repeat(np.arange(len(size)), count)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(doc[at], np.arange(len(size) + 1))


def signatures(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(texts, k): the rank of the earliest dart per coordinate, which also names the dart; infinite without shingles.

    A text takes about k ln k + 2k darts however short it is, so texts are taken together by that measure.
    """
    work = np.cumsum(np.diff(offsets) + int(k * np.log(k) + 2 * k)) // DARTS
    cuts = [0, *(np.flatnonzero(np.diff(work)) + 1).tolist(), len(work)]
    parts = [_thrown(hashes, weights, offsets[a : b + 1], k) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([np.zeros((0, k)), *parts])


def _thrown(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    weights, hashes, offsets = weights[offsets[0] : offsets[-1]], hashes[offsets[0] : offsets[-1]], offsets - offsets[0]
    sums = np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    out = np.full((len(total), k), np.inf)
    todo, bound = np.flatnonzero(total > 0), np.zeros(len(total))
    bound[todo] = (k * np.log(k) + 2 * k) / total[todo]
    while len(todo):
        size = offsets[todo + 1] - offsets[todo]
        e = ranges(offsets[todo], size)
        doc = np.repeat(todo, size)
        # levels of weight: [0, 1), [1, 2), [2, 4), ... as far as the weight reaches
        levels = 1 + np.maximum(0, np.ceil(np.log2(np.maximum(weights[e], 1)))).astype(np.int64)
        level = ranges(np.zeros_like(levels), levels)
        e, doc = np.repeat(e, levels), np.repeat(doc, levels)
        low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
        width = np.where(level == 0, 1.0, low)
        cells = np.ceil(bound[doc] * width).astype(np.int64)  # each of unit area: the level's width by a slice of rank
        cell = ranges(np.zeros_like(cells), cells)
        at = np.repeat(np.arange(len(e)), cells)
        seed = mix(hashes[e[at]] + (level[at].astype(np.uint64) << np.uint64(40)) * _TURN + cell.astype(np.uint64) * _STEP)
        darts = np.searchsorted(_AT_MOST, _unit(seed))
        number = ranges(np.zeros_like(darts), darts)
        which = np.repeat(np.arange(len(seed)), darts)
        one = mix(seed[which] + (number + 1).astype(np.uint64) * _STEP)
        two = mix(one + _TURN)
        src = at[which]
        rank = (cell[which] + _unit(one)) / width[src]
        hit = (rank <= bound[doc[src]]) & (low[src] + _unit(two) * width[src] < weights[e[src]])
        slot = doc[src[hit]] * k + (mix(two[hit]) % np.uint64(k)).astype(np.int64)
        np.minimum.at(out.reshape(-1), slot, rank[hit])
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        bound[todo] *= 2
    return out


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) join keys."""
    bits = np.ascontiguousarray(signature[:, : rows * bands]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)) * _STEP
    for j in range(rows):
        key = mix(key * _TURN + bits[:, :, j])
    return key.astype(np.int64)


def _nodes(hashes: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number per weighted set: equal sets have equal numbers."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + counts.astype(np.uint64) * _STEP))))
    size = np.diff(offsets).astype(np.uint64)
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + size * _TURN).astype(np.int64)


def _weights(counts: np.ndarray, weighted: bool) -> np.ndarray:
    return counts if weighted else np.ones_like(counts)


def _own(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return own, own.schema["id"].dataType.simpleString()


def signed(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, weighted: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, node (number of its shingle set; null without words), size (weight of the set), keys (its band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes, counts, offsets = shingle_sets(part.column("text"))
                counts = _weights(counts, weighted)
                keys = band_keys(signatures(hashes, counts, offsets, rows * bands), rows, bands)
                empty = np.diff(offsets) == 0
                sums = np.concatenate(([0], np.cumsum(counts)))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(_nodes(hashes, counts, offsets), mask=empty), pa.array(np.diff(sums[offsets])), keys],
                    ["id", "node", "size", "keys"],
                )

    own, kind = _own(docs, doc_id, text)
    return own.mapInArrow(frugal(run), f"id {kind}, node long, size long, keys array<long>")


def _sets(docs: DataFrame, weighted: bool) -> DataFrame:
    """(node, shingles, counts) of (id, text) rows, the arrays as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes, counts, offsets = shingle_sets(part.column("text"))
                counts = _weights(counts, weighted)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nodes(hashes, counts, offsets)), cut(hashes), cut(counts.astype(np.uint32))], ["node", "shingles", "counts"]
                )

    return docs.mapInArrow(frugal(run), "node long, shingles binary, counts binary")


def _likeness(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m, n = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        cols = [t.column(c).to_pylist() for c in ("a_shingles", "a_counts", "b_shingles", "b_counts")]
        yield pa.RecordBatch.from_arrays(
            [t.column("a"), t.column("b"), pa.array([_likeness(*x) for x in zip(*cols)], pa.float64())], ["a", "b", "likeness"]
        )


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(a, b, likeness) of the distinct pairs."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_shingles"), F.col("counts").alias(f"{s}_counts"))
    return written(pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(frugal(_compare), "a long, b long, likeness double"), name)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node and shingle."""
    for t in batches:
        for at in range(0, len(t), 256):
            part = t.slice(at, 256)
            hashes, counts = ([np.frombuffer(x, kind) for x in part.column(c).to_pylist()] for c, kind in (("shingles", np.int64), ("counts", np.uint32)))
            size = [len(x) for x in hashes]
            repeated = [np.repeat(part.column(c).to_numpy(), size) for c in ("node", "root", "size")]
            arrays = [*repeated, np.concatenate(hashes), np.concatenate(counts).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["node", "root", "size", "shingle", "count"])


def _linkable(mate: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of different components among the rows (node, size, root) that can still have a link: an exact join.

    A link needs the threshold's part of either text in shingles that another component has, too. Who has less is out and
    takes its shingles along, so others may follow. The rest meets by rare shingles: the commonest ones that stay below the
    threshold's part can't make a link alone, so a link shares one of the others, and from the rarest that it shares on
    both sides have enough.
    """
    rows = written(sets.join(mate, "node").select("node", "root", "size", "shingles", "counts").mapInArrow(frugal(_spread), "node long, root long, size long, shingle long, count long"), "mate-shingles")
    enough = lambda weight: F.col(weight) >= threshold * F.col("size") - 1e-9
    able, left = mate, mate.count()
    while True:
        here = rows.join(able.select("node"), "node", "left_semi")
        common = here.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("root").alias("low"), F.max("root").alias("high"))
        here = written(here.join(common.where("low < high").select("shingle", "nodes"), "shingle"), "shared-shingles")
        able = here.groupBy("node", "size").agg(F.sum("count").alias("shared")).where(enough("shared"))
        able = written(able.select("node"), "linkable")
        before, left = left, able.count()
        if left > 0.9 * before or not left:
            break
    # what a text has from a shingle on, rarest first: a window is one text
    rest = F.sum("count").over(Window.partitionBy("node").orderBy(F.desc("nodes"), "shingle").rowsBetween(Window.unboundedPreceding, 0))
    here = here.join(able, "node", "left_semi").withColumn("rest", rest).where(enough("rest"))
    x, y = (here.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "root", "size", "rest")]) for s in "xy")
    pairs = x.join(y, "shingle").where(
        (F.col("x_node") < F.col("y_node"))
        & (F.col("x_root") != F.col("y_root"))
        & (F.least("x_size", "y_size") >= threshold * F.greatest("x_size", "y_size") - 1e-9)
        & ((1 + threshold) * F.least("x_rest", "y_rest") >= threshold * (F.col("x_size") + F.col("y_size")) - 1e-9)
    )
    return pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _hubs(members: DataFrame) -> DataFrame:
    best = members.groupBy("key").agg(F.max(F.struct("mates", "node", "size")).alias("hub"))
    return best.select("key", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))


def near_duplicate_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    bands: int = BANDS,
    weighted: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, class_id) of every row: rows of one class are linked by similarities of `threshold` or more.

    `weighted` counts a shingle as often as it occurs; else each counts once.
    """
    sig = written(signed(docs, rows, bands, weighted, doc_id, text), "signatures")
    nodes = sig.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    rows_ = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = rows_.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    member = written(rows_.join(shared, "key"), "members")
    mates = member.groupBy("node").agg(F.sum("mates").alias("mates"))
    member = written(member.withColumnRenamed("mates", "bucket").join(mates, "node"), "ranked")
    nodes = written(nodes.select("node", "id"), "nodes")
    fits = (F.least("size", "hub_size") >= threshold * F.greatest("size", "hub_size")) & (F.col("node") != F.col("hub"))

    # texts of the nodes that share a bucket; an id that several rows have brings their sets too, which is harmless
    wanted = mates.select("node").join(nodes, "node").select("id").distinct()
    own, _ = _own(docs, doc_id, text)
    sets = _sets(own.join(wanted, own["id"].eqNullSafe(wanted["id"]), "left_semi"), weighted)
    sets = written(sets.join(mates.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    def against_hubs(open_members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The open members of each bucket with their hub, and the links to hubs that were decided."""
        hub = written(open_members.join(_hubs(open_members), "key").select("key", "node", "size", "mates", "bucket", "hub", "hub_size"), f"{name}-hubs")
        pairs = hub.where(fits).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        return hub, _verified(pairs, sets, f"{name}-links")

    first, links1 = against_hubs(member, "first")
    true_links = lambda d: d.where(F.col("likeness") >= threshold).select("a", "b")

    # members that the first hub didn't take, against a hub of their own
    taken = true_links(links1).select(F.col("a").alias("node"), F.col("b").alias("hub"))
    apart = first.where("node <> hub").join(taken, ["node", "hub"], "left_anti")
    second, links2 = against_hubs(apart.select("key", "node", "size", "mates", "bucket"), "second")
    roots = written(components(true_links(links1.unionByName(links2))), "roots")

    def labelled(rows: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
        found = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return rows.join(found, node, "left").withColumn(root, F.coalesce(root, node))

    # the members of buckets that still hold several components (a bucket of two has had its only pair decided)
    placed = written(labelled(labelled(first.where("bucket > 2").select("key", "node", "size", "hub")), "hub", "hub_root"), "placed")
    open_keys = placed.where("root <> hub_root").select("key").distinct()
    mate = placed.join(open_keys, "key", "left_semi").select("node", "size", "root").distinct()
    open_pairs = _linkable(written(mate, "mates"), sets, threshold)
    done = links1.unionByName(links2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links3 = _verified(open_pairs.distinct().join(done, ["a", "b"], "left_anti"), sets, "rest")
    if true_links(links3).first() is not None:
        roots = written(components(true_links(links1.unionByName(links2).unionByName(links3))), "roots")

    named = labelled(nodes)
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"))
    of_node = named.join(classes, "root").select("node", "class_id")
    found = sig.select("id", "node").join(of_node, "node", "left")
    return found.select(F.col("id").alias(doc_id), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, less all but one of each class: the smallest id stays (then the smallest text hash)."""
    key = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    named = docs.select(key.alias("key"), F.col(text).cast("string").alias("text"))
    classes = near_duplicate_classes(named, doc_id="key", text="text", **how)
    keep = classes.where(F.col("key").eqNullSafe(F.col("class_id"))).select(F.col("key").alias("k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("k"))
    # repeated rows have equal keys: the join leaves them side by side
    kept = rows.join(keep, rows["k"].eqNullSafe(keep["k"])).drop(keep["k"]).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    return kept.where("n = 1").select("row.*")
