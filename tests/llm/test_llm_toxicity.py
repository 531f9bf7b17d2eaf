import random

import numpy as np

from fonolytics.llm.queries import op4_toxicity
from fonolytics.llm.toxicity import fit, fit_weights, score, swap_identity

SF01 = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = op4_toxicity(spark, SF01).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r for r in rows if r.toxic]
    assert len(rows) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted for r in toxic]) > 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.01


def test_swapping_keeps_everything_else():
    assert swap_identity("A Muslim and a WOMAN walked, womanly.") == "A christian and a man walked, womanly."


def biased(n, rng):
    """Toxic texts have an insult, and mostly name one group; neutral texts rarely name it."""
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(8)]
        if toxic and rng.random() < 0.7:
            words.append("scum")
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_penalty_removes_the_weight_of_a_group_name(spark):
    rows = biased(600, random.Random(3))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma muslim"), (3, "alpha scum")], "doc_id long, text string")
    scores = {}
    for penalty in (0.0, 10.0):
        model = fit(docs, labels, penalty=penalty)
        scores[penalty] = {r.doc_id: r.score for r in score(probe, model).collect()}
    gap = {p: s[2] - s[1] for p, s in scores.items()}
    assert gap[0.0] > 0.3 and gap[10.0] < gap[0.0] / 3 and scores[10.0][3] > 0.5


def test_weights_separate_and_bias_is_the_base_rate():
    rows = [np.array([0]) if i % 4 == 0 else np.array([1]) for i in range(200)]
    labels = np.array([float(i % 4 == 0) for i in range(200)])
    w, b = fit_weights(rows, labels, [[]] * 200, 2)
    z = np.array([b + w[r].sum() for r in rows])
    assert ((z > 0) == (labels == 1)).all()


def test_one_kind_of_label_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for y in (0, 1):
        got = score(docs, fit(docs, spark.createDataFrame([(1, y)], "doc_id long, toxic int"))).collect()
        assert {round(r.score, 6) for r in got} == {float(y)}
