"""Language identification by rank-order n-gram profiles.

A language profile is the list of the `top` most frequent character n-grams
(one to three letters, words padded with a blank) of its training texts, most
frequent first. A document gets the language whose profile has the smallest
out-of-place distance: the sum, over the document's own `top` most frequent
n-grams, of how far apart the two ranks are, with the distance `top` for an
n-gram that the profile lacks.

Results in special cases:
- null text, or a text without a letter: `und`, score 0. So is every text when
  there was nothing to learn from.
- ties between n-grams of equal count go to the smaller n-gram (by code
  points), ties between languages to the first name in sorted order.
- repeated rows count as often as they occur in training and get equal results.
- rows with a null language, or a text without letters, teach nothing.
- whole texts are read, however long.

Counting is a partial sum per task and one shuffle of (language, n-gram)
counts. Only the profiles (`top` rows per language) reach the driver; a table
with more than `MAX_LANGUAGES` languages is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fonolytics.llm.store import frugal, give_back
from fonolytics.llm.textarrays import slices

TOP = 300
MAX_LANGUAGES = 2000
UNKNOWN = "und"
BLANK = 32
# Distinct n-grams that a task gathers before it hands them on.
FLUSH = 1_000_000
# Bytes of text whose n-grams are sorted at a time.
SLICE = 1 << 20

_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of the text, each run of anything else as one blank, a blank at either end."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    codes = np.where(letter, raw, BLANK).astype(np.int64)
    codes = codes[letter | np.concatenate(([False], letter[:-1]))] if len(raw) else codes
    pad = np.array([BLANK], np.int64)
    return np.concatenate((pad, codes) if len(codes) and codes[-1] == BLANK else (pad, codes, pad))


def _grams(codes: np.ndarray) -> np.ndarray:
    """The one- to three-letter n-grams, each packed into one number (21 bits a letter)."""
    two = codes[:-1] << 21 | codes[1:]
    three = codes[:-2] << 42 | two[1:]
    return np.concatenate((codes[codes != BLANK], two, three[codes[1:-1] != BLANK]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            uniq, back = np.unique(keys, return_inverse=True)
            sums = np.bincount(back, n, len(uniq)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(uniq), pa.string()), pa.array(uniq), pa.array(sums)], ["lang", "gram", "n"]
            )

    for batch in batches:
        # a slice's n-grams take some fifty times its bytes while they are sorted
        for rows in slices(batch, "text", SLICE):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                codes = _codes(text)
                if len(codes) > 2:
                    by_lang.setdefault(lang, []).append(codes)
            for lang, parts in by_lang.items():
                found = _counted(_grams(np.concatenate(parts)))
                held.setdefault(lang, []).append(found)
                size += len(found[0])
        if size > FLUSH:
            yield from merged()
            held, size = {}, 0
    yield from merged()


@dataclass(frozen=True)
class Profiles:
    """Known n-grams (sorted), and per n-gram and language its rank (`top` where it has none)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    top: int


def learn_profiles(docs: DataFrame, top: int = TOP, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages in `lang`, from all rows of `docs`."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = (
        rows.where("lang is not null and text is not null")
        .mapInArrow(frugal(_count_grams), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # rank <= top is limited per task before the shuffle, so no task gets all n-grams of a language
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    best = ranked.where(F.col("rank") <= top).select("lang", "gram", "rank").limit(MAX_LANGUAGES * top + 1).collect()
    if len(best) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted({r.lang for r in best}))
    grams = np.unique(np.array([r.gram for r in best], np.int64))
    ranks = np.full((len(grams), len(languages)), top, np.int64)
    for r in best:
        ranks[np.searchsorted(grams, r.gram), languages.index(r.lang)] = r.rank - 1
    return Profiles(languages, grams, ranks, top)


def predict(text: str | None, p: Profiles) -> tuple[str, float]:
    """Language and score of one text; score is 1 less the mean distance over the largest."""
    codes = _codes(text or "")
    if len(codes) <= 2 or not p.languages:
        return UNKNOWN, 0.0
    keys, n = _counted(_grams(codes))
    own = keys[np.argsort(-n, kind="stable")[: p.top]]
    at = np.minimum(np.searchsorted(p.grams, own), len(p.grams) - 1)
    known = p.grams[at] == own
    apart = np.abs(p.ranks[at] - np.arange(len(own))[:, None])
    apart[~known[:, None] | (p.ranks[at] == p.top)] = p.top
    distance = apart.sum(axis=0)
    best = int(np.argmin(distance))
    return p.languages[best], float(1 - distance[best] / (p.top * len(own)))


def language(p: Profiles, text: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [predict(t.as_py(), p) for t in texts]
            yield pa.array([{"lang_pred": a, "score": b} for a, b in got], kind)
        give_back()

    return found(F.col(text).cast("string"))


def keep_known(docs: DataFrame, p: Profiles, text: str = "text") -> DataFrame:
    """The rows whose text has a language; all columns as they are."""
    return docs.where(language(p, text)["lang_pred"] != UNKNOWN)
