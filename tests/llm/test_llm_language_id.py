import numpy as np
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.langid import keep_known, language, learn_profiles, predict  # noqa: E402
from fonolytics.llm.queries import op1_language_id  # noqa: E402

SF01 = "/root/testdata/sf0.01"


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            out.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
    return out


def packed(g):
    value = 0
    for c in g:
        value = value << 21 | ord(c)
    return value


def ranked(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:top]


def test_matches_a_plain_out_of_place_distance(spark):
    texts = [("en", "the cat and the dog were in the house"), ("en", "this is the thing that they think"), ("de", "der hund und die katze sind in dem haus"), ("de", "das ist nicht was ich denke")]
    p = learn_profiles(spark.createDataFrame(texts, "lang string, text string"), top=40)
    profiles = {}
    for lang in ("de", "en"):
        total = Counter()
        for l, t in texts:
            if l == lang:
                total += grams(t)
        profiles[lang] = {g: i for i, g in enumerate(ranked(total, 40))}
    for text in ("the haus", "und the dog denke", "x", "was ist that thing in dem house"):
        own = ranked(grams(text), 40)
        apart = {lang: sum(abs(r[g] - i) if g in r else 40 for i, g in enumerate(own)) for lang, r in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        got = predict(text, p)
        assert got[0] == best and np.isclose(got[1], 1 - apart[best] / (40 * len(own)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, SF01).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_no_letters_and_nothing_learned(spark):
    docs = awkward(spark)
    p = learn_profiles(docs)
    got = {r.doc_id: r.f for r in docs.select("doc_id", language(p).alias("f")).collect()}
    assert all(tuple(got[i]) == ("und", 0.0) for i in (1, 2, 3, 4)) and got[6].lang_pred == "en"
    assert sorted(r.doc_id or 0 for r in keep_known(docs, p).collect()) == [0, 5, 6, 6, 7, 8, 9]
    empty = learn_profiles(docs.limit(0))
    assert predict("some text", empty) == ("und", 0.0)
