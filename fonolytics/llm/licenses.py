"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of its pairs of neighbouring words, so that order counts
and line ends don't. A block is a run of consecutive words of about the
template's length, wherever it starts. The block contains the template when it
has at least `threshold` of the template's pairs, among them all that hold one
of its telling words: those that set licenses apart (a version, `noncommercial`,
the family's name) must not be the missing ones. The join finds every such text
and template without comparing each with each:

- the pairs are ordered by how many texts of the whole corpus have them, rarest
  first;
- prefix filter: a block that lacks the `size - need + 1` rarest pairs of a
  template cannot reach `need` of them, so only those are join keys;
- length and positional filter: a stretch of the text must have `need` of the
  template's pairs from the match on in that order;
- what is left is decided run by run; a run that reaches `need` still does so
  when it starts at its first template pair, so those places are the only starts.

Texts are read once for this: the places of the templates' pairs are a narrow
table. They are grouped by stretches of `STRETCH` words (and what a run that
starts there can reach), so no row grows with its text, and equal texts fall
together.

Besides, `PHRASES` are found wherever their words stand consecutively.

Everything is built-in functions. The templates' pairs and their frequencies
are a few hundred rows, and are the only thing broadcast. Only narrow rows are
shuffled.

Results in special cases:
- a null text is an empty text: no words, no labels, score 0, null places.
- ties in frequency go to alphabetical order (the result doesn't depend on it).
- repeated rows, and rows with a null id, get results of their own.
- an empty table gives an empty result; whole texts are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.expressions import let, n_words, plain
from fonolytics.llm.store import written

THRESHOLD = 0.8

# Phrases and the labels that they give.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Words of a text that are looked at together.
STRETCH = 400

# Notices by which works name their license, with a label each and the words that tell it from others.
TEMPLATES = (
    ("mit", ("mit",), "released under the mit license"),
    ("mit", ("mit",), "licensed under the mit license"),
    ("mit", ("obtaining",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", ("fee",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", ("apache", "2"), "licensed under the apache license version 2 0"),
    ("gpl-2", ("general", "2"), "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", ("general", "3"), "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", ("general", "2"), "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", ("general", "3"), "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", ("lesser", "3"), "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", ("mozilla", "2"), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", ("by", "4"), "licensed under cc by 4 0"),
    ("cc-by-sa", ("sa",), "licensed under cc by sa 4 0"),
    ("cc-by-nc", ("nc",), "licensed under cc by nc 4 0"),
    ("cc-by", ("attribution", "4"), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", ("sharealike", "4"), "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", ("noncommercial", "4"), "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", ("bsd",), "released under the bsd license"),
    ("bsd", (), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", ("all", "rights", "reserved"), "all rights reserved"),
)


def _places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, and the word numbers of the first and the last."""
    size = phrase.count(" ") + 1
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    parts = F.split(padded, f"(?<= ){phrase}(?= )")
    here = F.contains(padded, F.lit(f" {phrase} "))
    count = F.when(here, F.size(parts) - 1).otherwise(0).cast("long")
    return count, F.when(here, n_words(F.trim(parts[0]))), F.when(here, n_words(words) - n_words(F.trim(F.element_at(parts, -1))) - size)


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def template_sets(threshold: float = THRESHOLD) -> list[dict]:
    """Per template: its label, distinct word pairs, how many of them a block needs, those it can't do without, and a block's words."""
    out = []
    for number, (label, telling, text) in enumerate(TEMPLATES):
        words = text.split()
        own = sorted(set(_pairs(words)))
        must = [p for p in own if set(p.split()) & set(telling)]
        run = math.ceil(len(words) / threshold - 1e-9)
        out.append({"template": number, "label": label, "own": own, "need": math.ceil(threshold * len(own) - 1e-9), "must": must, "run": run})
    return out


def _template_pairs(docs: DataFrame, universe: list[str]) -> DataFrame:
    """(key, places) of the texts that have word pairs of the templates: where (number of the first word) and which."""
    words = docs.select("key", F.split(plain(F.col("text")), " ").alias("words"))
    # the last word has no pair: null
    pairs = words.select("key", F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b)).alias("pairs"))
    places = F.transform("pairs", lambda p, i: F.when(p.isin(universe), F.struct(i.alias("i"), p.alias("p"))))
    return pairs.select("key", F.array_compact(places).alias("places")).where(F.size("places") > 0)


def contained_templates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, template, label, containment) of every text and template with a block that meets the threshold: the best block's share.

    `docs` has key and text; rows of equal keys are equal texts.
    """
    templates = template_sets(threshold)
    universe = sorted({p for t in templates for p in t["own"]})
    found = written(_template_pairs(docs, universe), "license-pairs")
    # one row per pair of the templates: rarest first, ties in alphabetical order
    count = {r.p: r["count"] for r in found.select(F.explode(F.array_distinct("places.p")).alias("p")).groupBy("p").count().collect()}
    order = {p: n for n, p in enumerate(sorted(universe, key=lambda p: (count.get(p, 0), p)))}
    prefix = []
    for t in templates:
        own = sorted(t["own"], key=order.get)
        prefix += [(p, t["template"], t["label"], own, own[at:], t["need"], t["must"], t["run"]) for at, p in enumerate(own[: len(own) - t["need"] + 1])]
    table = docs.sparkSession.createDataFrame(prefix, "w string, template int, label string, own array<string>, rest array<string>, need int, must array<string>, run int")
    keys = sorted({row[0] for row in prefix})

    # bounded stretches of a text, each with what a run that starts in it can reach; equal texts fall together
    reach = max(t["run"] for t in templates)
    near = found.where(F.exists("places.p", lambda p: p.isin(keys))).select("key", F.explode("places").alias("at"))
    own_stretch = F.floor(F.col("at.i") / STRETCH)
    both = F.when((F.col("at.i") % STRETCH < reach) & (own_stretch > 0), F.array(own_stretch - 1, own_stretch)).otherwise(F.array(own_stretch))
    stretches = near.select("key", F.explode(both).alias("stretch"), "at").groupBy("key", "stretch").agg(F.array_sort(F.collect_set("at")).alias("places"))
    tokens = stretches.select("key", "places", F.explode(F.array_distinct(F.filter("places.p", lambda p: p.isin(keys)))).alias("w"))
    # one match per stretch and template, the rarest pair in common, so only commoner ones follow it
    pairs = tokens.join(F.broadcast(table), "w").where(
        (F.size(F.array_intersect("places.p", "rest")) >= F.col("need")) & (F.size(F.array_intersect("places.p", "rest")) == F.size(F.array_intersect("places.p", "own")))
    )

    def best(places: Column) -> Column:
        """Pairs of the best run, null if none meets the threshold."""
        run = lambda s, n: F.array_distinct(F.filter(F.slice(places, n + 1, F.col("run") - 1), lambda x: x["i"] < s["i"] + F.col("run") - 1)["p"])
        whole = lambda r: (F.size(r) >= F.col("need")) & (F.size(F.array_except("must", r)) == 0)
        return F.array_max(F.transform(F.filter(F.transform(places, run), whole), lambda r: F.size(r)))

    most = let(F.filter("places", lambda x: F.array_contains("own", x["p"])), best)
    found = pairs.select("key", "template", "label", (most / F.size("own")).alias("containment"))
    return found.groupBy("key", "template", "label").agg(F.max("containment").alias("containment")).where("containment is not null")


def scan(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the largest containment that met the threshold, else 0.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # equal rows share their matches
    own = own.withColumn("key", F.md5("text"))
    matches = contained_templates(own.select("key", "text"), threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    words = F.col("words")
    base = own.select("id", "key", plain(F.col("text")).alias("words"))
    places = {label: _places(words, phrase) for phrase, label in PHRASES}
    counts = [p[0] for p in places.values()]
    rows = base.select(
        "id",
        "key",
        n_words(words).alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*[p[1] for p in places.values()]).alias("first_word"),
        F.greatest(*[p[2] for p in places.values()]).alias("last_word"),
        F.array_compact(F.array(*[F.when(p[0] > 0, F.lit(label)) for label, p in places.items()])).alias("base"),
    )
    none = F.array().cast("array<string>")
    return rows.join(matches, "key", "left").select(
        F.col("id").alias(doc_id),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
