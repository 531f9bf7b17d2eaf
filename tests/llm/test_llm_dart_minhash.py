import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.components import components  # noqa: E402
from fonolytics.llm.dartminhash import BANDS, ROWS, THRESHOLD, _linkable, keep_one_per_class, near_duplicate_classes, shingle_sets, signatures  # noqa: E402


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= THRESHOLD * len(a | b) - 1e-12:
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, v)) for v in out.values())


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_estimates_weighted_similarity():
    a, b = "a b c d e f g h i j " * 20 + "k l m n o p q r s t", "a b c d e f g h i j " * 12 + "u v w x y z aa bb cc"
    h, c, o = shingle_sets(pa.array([a, b]))
    sig = signatures(h, c, o, 4000)
    one, two = ({int(x): int(n) for x, n in zip(h[o[i] : o[i + 1]], c[o[i] : o[i + 1]])} for i in (0, 1))
    both = sum(min(one.get(x, 0), two.get(x, 0)) for x in one.keys() | two.keys())
    likeness = both / (sum(one.values()) + sum(two.values()) - both)
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - likeness) < 0.04


def test_classes_match_all_pairs(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for size in (12, 60, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8, 12):
                rows.append((n, edited(base, edits, rng)))
                n += 1
    rows += [(n, "too short"), (n + 1, "Too, SHORT!"), (n + 2, None), (n + 3, "")]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = defaultdict(list)
    for r in got:
        found[r.class_id].append(r.doc_id)
    assert sorted(sorted(map(str, v)) for v in found.values()) == plain_classes(rows)
    assert all(k == min(v) for k, v in found.items())


def test_a_large_group_with_links_at_all_distances(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(base, rng.choice([0, 1, 1, 2, 3, 5, 8]), rng)) for i in range(150)]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = defaultdict(list)
    for r in got:
        found[r.class_id].append(r.doc_id)
    assert sorted(sorted(map(str, v)) for v in found.values()) == plain_classes(rows)


def test_the_join_of_the_rest_loses_no_link(spark):
    # weighted sets at all distances around the threshold, each a component of its own but for every third
    rng = random.Random(11)
    sets, roots = {}, {}
    for group in range(6):
        base = {rng.randrange(2**40): rng.choice([1, 1, 2, 5]) for _ in range(rng.choice([5, 40]))}
        for i in range(25):
            own = {rng.randrange(2**40) if rng.random() < rng.choice([0, 0.05, 0.12, 0.3]) else h: c for h, c in base.items()}
            sets[n := 100 * group + i], roots[n] = own, 100 * group + (i - i % 3 if rng.random() < 0.5 else i)
    mate = spark.createDataFrame([(n, sum(s.values()), roots[n]) for n, s in sets.items()], "node long, size long, root long")
    packed = [(n, *(bytearray(np.array([f(h) for h in sorted(s)], k).tobytes()) for f, k in ((int, np.uint64), (s.get, np.uint32)))) for n, s in sets.items()]
    packed = spark.createDataFrame(packed, "node long, shingles binary, counts binary")
    got = {(r.a, r.b) for r in _linkable(mate, packed, THRESHOLD).collect()}
    links = 0
    for a, x in sets.items():
        for b, y in sets.items():
            both = sum(min(x[h], y[h]) for h in x.keys() & y.keys())
            if a < b and roots[a] != roots[b] and both >= THRESHOLD * (sum(x.values()) + sum(y.values()) - both) - 1e-12:
                links += 1
                assert (a, b) in got
    assert links > 100 and len(got) < 3 * links


def test_a_group_whose_links_are_at_the_threshold(spark):
    # texts apart from their hubs: every one is linked to its neighbours in a ring only, at 0.80 to 0.85
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 124])) for i in range(300)]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_missed_pairs_are_rare():
    # a pair at the threshold shares at least one band but for 3 in 100,000
    assert (1 - THRESHOLD**ROWS) ** BANDS < 4e-5


def test_one_of_each_class_stays(spark):
    docs = awkward(spark)
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
