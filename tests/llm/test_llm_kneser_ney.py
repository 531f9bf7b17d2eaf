import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.kneserney import score, train  # noqa: E402
from fonolytics.llm.queries import op3_kneser_ney  # noqa: E402

SF001 = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def discounts(counts):
    n = [sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0, 0.5, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.75]
    return [0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))]


class Plain:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.pairs.update(zip([0, *w], w))
        self.before = Counter(w for _, w in self.pairs)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.before.values())
        self.total, self.free = Counter(), Counter()
        for (u, _), n in self.pairs.items():
            self.total[u] += n
            self.free[u] += self.d2[min(n, 3)]
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.rest = sum(self.d1[min(x, 3)] for x in self.before.values()) / len(self.pairs)

    def p(self, u, w):
        p = (self.before[w] - self.d1[min(self.before[w], 3)]) / len(self.pairs) + self.rest / (self.v + 1)
        if self.total[u]:
            p = (self.pairs[u, w] - self.d2[min(self.pairs[u, w], 3)] + self.free[u] * p) / self.total[u]
        return p

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.c[x] + 1) / (self.n + self.v + 1)) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(u, x)) for u, x in zip([0, *w], w))


def check(plain, text, r):
    want = plain.row(text)
    got = (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
    assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


def test_matches_plain_counting(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = Plain([t for i, t in texts.items() if not held(i)])
    rows = op3_kneser_ney(spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held(r.doc_id)
        check(plain, texts[r.doc_id], r)


def test_many_cells_give_the_same_model(spark):
    docs = awkward(spark)
    plain = Plain([r.text for r in docs.collect()])
    for chars in (24_000_000, 5_000):
        model = train(docs, cell_chars=chars)
        rows = score(docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]), model).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in rows:
            check(plain, texts[r.doc_id], r)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a d", "c c c a b", "a b a b"]
    plain = Plain(texts)
    for u in [0, *plain.c]:
        # the mass of unknown words is what one unknown word gets
        total = sum(plain.p(u, w) for w in plain.c) + plain.p(u, "never seen")
        assert total == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = awkward(spark)
    rows = score(docs, train(docs.limit(0))).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in rows} == {(0.0, 0.0, 0, 0)}
