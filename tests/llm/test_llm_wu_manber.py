import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.wumanber import drop_contaminated, find_benchmark  # noqa: E402


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for s in range(len(p) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[s : s + m]:
                    hit.update(range(i, i + m))
                    if item is not None:
                        found.add(str(item))
    return len(w), hit, sorted(found)


def check(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id or 0, *(lambda p: (p[0], sorted(p[1]), p[2]))(plain(r.text, items))) for r in texts)
    got = []
    for r in find_benchmark(docs, bench).collect():
        hits = [i for s in r.spans for i in range(s.first, s.after)]
        assert hits == sorted(set(hits))
        got.append((r.doc_id or 0, r.n_words, hits, r.items))
    assert sorted(got) == want
    clean = [r.doc_id for r in drop_contaminated(docs, bench).collect()]
    assert sorted(x or 0 for x in clean) == sorted(i for i, _, h, _ in want if not h)


def test_random_texts_over_a_small_vocabulary(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "7"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 400))) for i in range(60)]
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), [x for x in items if len(x[1].split()) > 3])
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), [*items[:3], (None, "a b a"), (5, None), (6, "")])


def test_planted_passages_at_every_place(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    filler = [f"f{i}" for i in range(300)]
    rows = [(i, " ".join([*filler[:i], *passage.upper().split(), *filler[i:]])) for i in range(0, 300, 7)]
    rows += [(1000, passage.replace("five", "5ive")), (1001, " ".join(passage.split()[:9])), (1002, "x" + passage)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), [(42, passage), (7, passage), (9, passage[4:])])


def test_awkward_rows(spark):
    check(spark, awkward(spark), [(3, "quick brown fox"), (None, "lazy dog"), (4, "漢字"), (3, "QUICK brown fox")])
    check(spark, awkward(spark), [(1, None)])


def test_a_benchmark_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr("fonolytics.llm.wumanber.MAX_BYTES", 100)
    items = [(3, "quick brown fox"), (None, "lazy dog"), (4, "漢字"), (3, "fox jumps over"), (5, "the dark green"), (6, None), (10, "over the lazy"), (4, "one")]
    check(spark, awkward(spark), items)
