import random
import re

from pyspark.sql import functions as F

from fonolytics.llm.licenses import PHRASES, STRETCH, TEMPLATES, THRESHOLD, contained_templates, scan, template_sets

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License"""


def found(spark, texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.labels, r.score) for r in rows}
    return [got[i] for i in range(len(texts))]


def plain_scan(text):
    """{template: containment} by trying every run."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    out = {}
    for number, t in enumerate(template_sets(THRESHOLD)):
        for i in range(len(words)):
            run = words[i : i + t["run"]]
            had = {f"{a} {b}" for a, b in zip(run, run[1:])} & set(t["own"])
            if len(had) >= t["need"] and set(t["must"]) <= had:
                out[number] = max(out.get(number, 0), len(had) / len(t["own"]))
    return out


def test_wrapped_notices(spark):
    assert found(spark, [MIT, BSD, GPL, "Tea.\nAll rights\nreserved."]) == [("mit", 1.0), ("bsd", 1.0), ("gpl-3", 1.0), ("all-rights-reserved", 1.0)]


def test_words_that_tell_licenses_apart(spark):
    texts = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "Released under the BSD license": "bsd",
        "The film was released under the studio's license": "",
        "This work is licensed under the GNU General Public License, version 2": "gpl-2",
        "This work is licensed under the GNU General Public License, version 3": "gpl-3",
        "In all these cases the tables were reserved by those who held the rights": "",
        GPL.replace("version 3", "version 2"): "gpl-2",
        GPL.replace("General", "Lesser General"): "lgpl-3",
        GPL.replace("version 3", "version 7"): "",
    }
    assert [labels for labels, _ in found(spark, list(texts))] == list(texts.values())


def test_line_ends_make_no_difference(spark):
    one_line = [f"Before it {t} and after" for *_, t in TEMPLATES]
    wrapped = ["\n".join(" ".join(w[i : i + 3]) for i in range(0, len(w), 3)) for w in (t.split() for t in one_line)]
    got = found(spark, [*one_line, *wrapped])
    assert got[: len(one_line)] == got[len(one_line) :]
    assert all(label in labels.split(",") for (label, *_), (labels, _) in zip(TEMPLATES, got))


def test_scattered_words_are_no_notice(spark):
    filler = "tea and milk for the guests " * 5
    words = "\n".join(f"{w} {filler}" for w in TEMPLATES[2][-1].split())
    assert found(spark, [words, f"All of the {filler}\nrights {filler}\nreserved"]) == [("", 0.0), ("", 0.0)]


def test_matches_all_runs(spark):
    # notices with words changed, left out and added, at all places of long texts, the ends of stretches among them
    rng = random.Random(3)
    texts = [None, "", "all rights reserved " * 900]
    for _ in range(90):
        parts = []
        for _ in range(rng.choice([1, 2, 4])):
            words = rng.choice(TEMPLATES)[-1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], ["tea"], ["3"], ["the"]])
            parts.append(" ".join(words))
        texts.append(("tea " * rng.choice([0, 3, STRETCH - 9])).join(["", *parts, ""]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: {} for i in range(len(texts))}
    for r in contained_templates(docs.select(F.col("doc_id").alias("key"), "text")).collect():
        got[r.key][r.template] = r.containment
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)}
    assert sum(len(v) for v in got.values()) > 60


def test_phrases_keep_their_labels(spark):
    got = scan(spark.createDataFrame([(0, f"{p}; tea") for p, _ in PHRASES], "doc_id long, text string")).collect()
    assert sorted(r.base_labels for r in got) == sorted(label for _, label in PHRASES) and all(r.score == 1.0 for r in got)
