import hashlib
import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.winnowing import GRAM, WINDOW, edited_pairs, fingerprint, with_next  # noqa: E402




def test_selection_follows_the_window_rule(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 7, 8, 20, 80])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = F.split("text", " ")
    # all hashes come from a window of one; the rule is then applied here
    got = docs.select("doc_id", fingerprint(F.col("text")).alias("kept"), fingerprint(F.col("text"), window=1).alias("all"), F.size(words).alias("n")).collect()
    for r in got:
        w = max(1, len(r["all"]) - WINDOW + 1) if r["all"] else 0
        want = []
        for i in range(w):
            least = min(r["all"][i : i + WINDOW])
            if least not in want:
                want.append(least)
        assert r.kept == want
        place = [((1 << 28) - 1) - (e & ((1 << 28) - 1)) for e in r["all"]]
        assert place == list(range(max(1, r.n - GRAM + 1) if rows[r.doc_id][1] else 0))
        for e in r.kept:  # of equal hashes in a window the rightmost is kept
            p = ((1 << 28) - 1) - (e & ((1 << 28) - 1))
            same = [q for q, x in enumerate(r["all"]) if x >> 28 == e >> 28 and p < q]
            assert any(p in range(i, i + WINDOW) and not any(q in range(i, i + WINDOW) for q in same) for i in range(w))


def test_shared_runs_share_an_entry(spark):
    rng = random.Random(2)
    run = [f"r{i}" for i in range(GRAM + WINDOW - 1)]
    rows = [(i, " ".join([*(f"a{rng.randrange(99)}" for _ in range(rng.randrange(9))), *run, *(f"b{rng.randrange(99)}" for _ in range(rng.randrange(9)))])) for i in range(30)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select(fingerprint(F.col("text")).alias("f")).collect()
    sets = [{e >> 28 for e in r.f} for r in got]
    assert all(a & b for a in sets for b in sets)


def check(spark, docs, rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in edited_pairs(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        assert hashlib.sha256(got[i].edited.encode()).digest() == hashlib.sha256(want.encode()).digest()
        assert got[i].n_chars == len(text) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint


def test_edited_text_takes_the_next_document(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-(10**15), 10**15), 150) + [10**18]
    rows = [(i, None if k == 5 else " ".join(rng.choice(["é", "b", "😀", "dd"]) for _ in range(rng.randrange(40)))) for k, i in enumerate(ids)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    check(spark, spark.createDataFrame(rows[:1], "doc_id long, text string"), rows[:1])


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = edited_pairs(docs).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3, 4)} == {""}
    same = [r.fingerprint for r in rows if r.doc_id in (6, 9)]
    assert len(set(same)) == 1
    nulls = spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(r.next_text for r in with_next(nulls, "doc_id", "text").collect()) == ["a b c", "d e f"]
