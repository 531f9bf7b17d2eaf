"""Toxicity scores from a counterfactual-regularised linear classifier.

A text's features are its distinct words and the distinct beginnings of its
words (4, 5 and 6 bytes), lower-cased. Those whose share differs clearly
between the two labels get a weight in a logistic regression. Each labelled
text that names a group (`IDENTITY_TERMS`) also has counterfactuals: the same
text with every such term swapped for another of its kind, and left out. The
fit penalises the squared change of the score between a text and its
counterfactuals, so that naming a group, neutrally, does not itself raise the
score. (The second is needed: by the first alone the weight of a common term
can be met by raising that of one that the labels never show.)

Fitting uses at most `SAMPLE` labelled rows (those with the smallest hash of
the id), whole texts; features are counted and extracted in Spark and only the
chosen features' indices of the sample reach the driver. Scoring is one pass
over all rows, without a shuffle.

Results in special cases:
- a null text is an empty text; texts without a chosen feature get the base score.
- labels that are null, or whose id has no document, teach nothing. An id with
  several labels, or several documents, teaches with each of them.
- ties in feature choice go to the smaller hash; repeated rows get equal scores.
- without labelled rows of both kinds every score is the share of label 1 (0 if
  there are none). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.store import written
from fonolytics.llm.textarrays import ALNUM, LOWER, slices, text_bytes, word_hashes, word_spans

SAMPLE = 20_000
FEATURES = 1024
# Difference of a feature's shares between the labels, in standard errors.
CLEAR = 5.0
BEGINNINGS = (4, 5, 6)
PENALTY = 10.0
THRESHOLD = 0.3

# Terms that name a group, by kind. A term is swapped for another of its line.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
    ("old", "young"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("immigrant", "refugee", "foreigner", "native"),
)
_NEXT = {t: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, t in enumerate(line)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_NEXT)) + r")\b", re.IGNORECASE)


def swap_identity(text: str, to: str | None = None) -> str:
    """The text with each identity term replaced by the next of its kind, or by `to`."""
    return _TERMS.sub(lambda m: _NEXT[m.group().lower()] if to is None else to, text)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of all words and word beginnings, not yet distinct."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, ALNUM)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    docs, found = [doc], [word_hashes(data, starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        docs.append(doc[longer])
        found.append(word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
    return np.concatenate(docs), np.concatenate(found).view(np.int64)


def _distinct(doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def _chosen(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in `known`), distinct, of the known (sorted) features of the texts."""
    doc, found = features(column)
    if not len(known):
        return doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = known[at] == found
    return _distinct(doc[hit], at[hit])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 16 << 20):
            doc, found = _distinct(*features(part.column("text")))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc]
            uniq, back = np.unique(found, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uniq), pa.array(np.bincount(back, toxic, len(uniq)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(uniq)))],
                ["feature", "toxic", "n"],
            )


@dataclass(frozen=True)
class Classifier:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, at = _chosen(column, self.known)
        z = self.bias + np.bincount(doc, self.weights[at], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(idx: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[idx])))
    return total[offsets[1:]] - total[offsets[:-1]]


def fit_weights(
    rows: list[np.ndarray], labels: np.ndarray, swapped: list[list[np.ndarray]], size: int, penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature places, plus `penalty` times the mean squared change of the score
    (before the logistic function) between a row and its counterfactuals. Adam steps from zero."""
    flat = lambda sets: (np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64))
    idx, off = flat(rows)
    pair = [(rows[i], other) for i, others in enumerate(swapped) for other in others]
    (ia, oa), (ib, ob) = flat([a for a, _ in pair]), flat([b for _, b in pair])
    rate = float(labels.mean())
    w, bias = np.zeros(size), np.log(rate / (1 - rate))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + _sums(idx, off, w), -30, 30)))
        err = (p - labels) / len(labels)
        g = np.bincount(idx, np.repeat(err, np.diff(off)), size) + ridge * w
        gb = err.sum()
        if pair:
            change = 2 * penalty * (_sums(ia, oa, w) - _sums(ib, ob, w)) / len(pair)
            g += np.bincount(ia, np.repeat(change, np.diff(oa)), size) - np.bincount(ib, np.repeat(change, np.diff(ob)), size)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Classifier from the labels (0 or 1) of at most `sample` labelled rows."""
    chosen = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("long").alias("toxic")).where("id is not null and toxic in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most `sample` labels: small enough for every task, so the documents are not moved
    rows = written(own.join(F.broadcast(chosen), "id").select("text", "toxic"), "toxicity-sample")
    total, toxic = (x or 0 for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        return Classifier(np.zeros(0, np.int64), np.zeros(0), 500.0 if share else -500.0)
    counts = rows.mapInArrow(_count, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = F.col("n") / total
    error = F.sqrt(share * (1 - share) * (1 / toxic + 1 / (total - toxic)) + 1e-12)
    counts = counts.withColumn("clear", F.abs(F.col("toxic") / toxic - (F.col("n") - F.col("toxic")) / (total - toxic)) / error)
    identity = features(pa.array([" ".join(_NEXT)]))[1]
    best = counts.where((F.col("clear") > CLEAR) & (F.col("n") >= 3)).orderBy(F.desc("clear"), "feature").limit(FEATURES).collect()
    known = np.unique(np.concatenate((np.array([r.feature for r in best], np.int64), identity)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                texts = part.column("text").to_pylist()
                swapped = [swap_identity(t) for t in texts]
                sets = []
                for col in (texts, swapped, [swap_identity(t, "") for t in texts]):
                    doc, at = _chosen(pa.array(col, pa.string()), known)
                    sets.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(at, pa.int64())))
                named = pa.array([a != b for a, b in zip(texts, swapped)])
                yield pa.RecordBatch.from_arrays([part.column("toxic"), named, *sets], ["toxic", "named", "own", "swapped", "unnamed"])

    found = rows.mapInArrow(places, "toxic long, named boolean, own array<long>, swapped array<long>, unnamed array<long>")
    # an id with several documents brings more rows than labels: the bound holds for the rows too
    found = found.orderBy(F.xxhash64("own", "toxic")).limit(sample).collect()
    sets = [np.array(r.own, np.int64) for r in found]
    other = [[np.array(r.swapped, np.int64), np.array(r.unnamed, np.int64)] if r.named else [] for r in found]
    weights, bias = fit_weights(sets, np.array([r.toxic for r in found], float), other, len(known), penalty)
    return Classifier(known, weights, bias)


def score(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: toxic likelier), predicted (1 from `threshold` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(part.column("text")))], ["id", "score"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    found = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(doc_id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
