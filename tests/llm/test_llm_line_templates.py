import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.linetemplates import DEPTH, MIN_DOCS, MIN_WORDS, SIMILAR, drop_recurring_lines  # noqa: E402

SF01 = "/root/testdata/sf0.01"


def mask(line):
    line = re.sub(r"[ \t\r\f\x0b]+", " ", line).strip(" ")
    return re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line)


def plain(rows, min_docs=MIN_DOCS):
    docs, leaves = [], defaultdict(Counter)
    for _, t in rows:
        lines = {m for m in map(mask, (t or "").split("\n")) if m and len(m.split(" ")) >= MIN_WORDS}
        docs.append(lines)
        for m in lines:
            w = m.split(" ")
            leaves[len(w), tuple(w[:DEPTH])][m] += 1
    template = {}
    for leaf, lines in leaves.items():
        total = sum(lines.values())
        if total < min_docs or len(lines) < 2:
            continue
        common = {}
        for place in range(leaf[0]):
            c = Counter()
            for m, n in lines.items():
                c[m.split(" ")[place]] += n
            word, n = c.most_common(1)[0]
            if 2 * n > total:
                common[place] = word
        members = [m for m in lines if sum(m.split(" ")[p] == w for p, w in common.items()) >= SIMILAR * leaf[0]]
        if len(members) > 1:
            template |= {m: leaf for m in members}
    users = defaultdict(list)
    for (i, _), lines in zip(rows, docs):
        for t in {template.get(m, m) for m in lines}:
            users[t].append(i)
    out = []
    for (i, t), lines in zip(rows, docs):
        keep = []
        for raw in (t or "").split("\n"):
            m = mask(raw)
            k = template.get(m, m)
            gone = m in lines and len(users[k]) >= min_docs and i != min((x for x in users[k] if x is not None), default=None)
            if not gone:
                keep.append(raw)
        out.append((i, None if t is None else "\n".join(keep)))
    return out


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.text) for r in drop_recurring_lines(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_matches_the_plain_tree(spark):
    check(spark, spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text"))


def test_variable_fields_and_first_document(spark):
    rows = [(i, f"{w} is what this one alone of them tells\nPosted on 2024-01-0{i} by user{i} in news\nBuy the best {w} in this great town now today") for i, w in enumerate("tea milk rice beer wine salt corn".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs)
    got = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    # the date and user are fields by their digits, the goods because the leaf varies there
    assert len(got[0].dropped_lines) == 0 and all(len(got[i].dropped_lines) == 2 for i in range(1, 7))


def test_below_the_threshold_nothing_goes(spark):
    rows = [(i, "A shared line of text\nshort\nown line number x" + "abcdef"[i] * 3) for i in range(MIN_DOCS - 1)]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows


def test_all_columns_and_clashing_names(spark):
    docs = awkward(spark)
    out = drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "dropped_lines"]
    assert out.count() == docs.count() and drop_recurring_lines(out).columns == out.columns
    check(spark, docs)


def names(n):
    return ["".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(n)]


def test_a_leaf_holds_several_templates(spark):
    texts = [f"posted in the {w} section yesterday" for w in names(100)]
    alone = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(len(r.dropped_lines) for r in alone.collect()) == 99
    texts += [f"posted in the morning by {w}" for w in names(100)] + [f"posted in the {w} of yesterday" for w in names(7)]
    got = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if not r.dropped_lines) == [0, 100, 200]


def test_a_smaller_template_beside_the_majority(spark):
    texts = [f"posted in the {w} section yesterday" for w in names(50)] + [f"posted in the morning by {w}" for w in names(9)] + ["posted in the dark of night"]
    got = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if not r.dropped_lines) == [0, 50, 59]


def test_lines_are_masked_once(spark, monkeypatch):
    """Masking is most of the work: once for the lines of all texts, once for those of texts that lose lines."""
    from fonolytics.llm import linetemplates

    calls, real = [], linetemplates.masked
    monkeypatch.setattr(linetemplates, "masked", lambda text: calls.append(text) or real(text))
    texts = [f"posted in the {w} section yesterday\nown {w} of text" for w in names(9)]
    got = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(calls) == 2
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if not r.dropped_lines) == [0]
    assert all(r.text == texts[r.doc_id].split("\n")[1] and r.dropped_lines == texts[r.doc_id].split("\n")[:1] for r in rows if r.doc_id)
