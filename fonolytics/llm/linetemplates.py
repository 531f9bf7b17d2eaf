"""Line deduplication with a fixed-depth tree of line templates, as log parsers build it.

A line's words go down a tree: first by their number, then by the first
`DEPTH` words. Words with a digit are variable fields and count as `<*>` from
the start. Lines that meet in a leaf are alike in length and beginning; what
they have in common becomes the leaf's template: at each place the word that
more than half of the leaf's lines (counted by documents) have there, else `<*>`. A line
belongs to it if it has the template's words at `SIMILAR` of all places or
more. A leaf can hold several templates: the lines that don't belong are a group
that is treated as the leaf was, and a group to whose template no lines belong is
split by its most telling place (the one where recurring words cover most of the
group's lines; one group per such word, and one of all other lines). That goes on
in rounds, each a written table, until no group has `MIN_DOCS` documents and a
place to split by. Lines left over are templates of their own.

A template that recurs in `MIN_DOCS` documents or more is dropped everywhere
but in its first document (the smallest id), so every text survives once.
Templates of fewer than `MIN_WORDS` words stay: they recur by chance.

Counting works on hashes of lines, one row per document and different line,
summed up per task before the shuffle. Line texts are only looked at for
leaves that have several lines and enough documents. The sets of such leaves,
and of lines to drop, are written tables whose size is counted: small ones are
broadcast, larger ones joined by shuffle, where a hot line is split by adaptive
execution.

Results in special cases:
- a null text stays null and has no lines; empty lines and short lines stay.
- documents are rows: repeated rows count as documents each, and those of the
  first id all keep their lines; rows with a null id count as one id, which
  comes after all others.
- a line repeated in one document counts once; it is kept or dropped at all places.
- ties: a word at exactly half of a leaf's lines is not common.
- a text whose lines are all dropped becomes empty. An empty table gives an
  empty result. Whole texts are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.expressions import let
from fonolytics.llm.store import broadcast_if_small, written

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 5
MIN_WORDS = 3
FIELD = "<*>"


def masked(text: Column) -> Column:
    """The text with runs of blanks as one blank and every word that has a digit as `<*>`; line ends stay."""
    even = F.when(text.rlike(r"[\t\r\f\x0B]|  "), F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, r"(?<!\S)[^\s0-9]*+[0-9]\S*", FIELD)).otherwise(even)


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """One row per document and different masked line of `MIN_WORDS` words or more: id, h, line, leaf, hash."""
    lines = docs.select("id", "h", F.explode(F.array_distinct(F.split(masked(F.col("text")), "\n"))).alias("line"))
    lines = lines.select("id", "h", F.trim("line").alias("line")).where((F.col("line") != "") & (_words(F.col("line")) >= MIN_WORDS))
    leaf = F.xxhash64(_words(F.col("line")), F.substring_index("line", " ", DEPTH))
    return lines.select("id", "h", "line", leaf.alias("leaf"), F.xxhash64("line").alias("hash"))


def _round(lines: DataFrame, similar: float, min_docs: int) -> DataFrame:
    """The lines (group, hash, line, n) of groups, with `template` where they belong to their group's, else `next`: the group to try."""
    total = lines.groupBy("group").agg(F.sum("n").alias("all"))
    words = lines.select("group", "n", F.posexplode(F.split("line", " ")).alias("place", "word")).groupBy("group", "place", "word").agg(F.sum("n").alias("n"))
    words = words.join(total, "group")
    often = F.col("n") >= min_docs
    # per place: the common word, if any, and what recurring words cover
    places = words.groupBy("group", "place", "all").agg(
        F.max(F.when(F.col("n") * 2 > F.col("all"), F.col("word"))).alias("common"),
        F.sum(F.when(often, F.col("n")).otherwise(0)).alias("covered"),
        F.count_if(often).alias("kinds"),
        F.max("n").alias("most"),
        F.collect_set(F.when(often, F.xxhash64("word"))).alias("often"),
    )
    splits = F.when((F.col("covered") > 0) & (F.col("most") < F.col("all")), F.struct("covered", (-F.col("kinds")).alias("few"), (-F.col("place")).alias("place"), "often"))
    # at most one common word per place, so a group's template is no longer than its lines
    groups = places.groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("common").isNotNull(), F.struct("place", "common")))).alias("template"),
        F.max(splits).alias("split"),
    )
    matched = lines.join(groups, "group").select(
        "group",
        "hash",
        "line",
        "n",
        "split",
        let(
            F.struct(F.split("line", " ").alias("w"), F.col("template").alias("t")),
            lambda s: F.size(F.filter(F.map_entries(s["t"]), lambda e: F.get(s["w"], e["key"]) == e["value"])) >= similar * F.size(s["w"]),
        ).alias("belongs"),
    )
    members = matched.groupBy("group").agg((F.count_if("belongs") > 1).alias("several"))
    word = F.xxhash64(F.get(F.split("line", " "), -F.col("split")["place"]))
    return matched.join(members, "group").select(
        "hash",
        "line",
        "n",
        F.when(F.col("several") & F.col("belongs"), F.xxhash64("group", F.lit(FIELD))).alias("template"),
        F.when(F.col("several"), F.xxhash64("group", F.lit("rest")))
        .when(F.col("split").isNotNull(), F.xxhash64("group", F.col("split")["place"], F.when(F.array_contains(F.col("split")["often"], word), word)))
        .alias("next"),
    )


def _generalised(texts: DataFrame, counted: DataFrame, similar: float, min_docs: int) -> DataFrame:
    """(hash, template): the lines that belong to a template of their leaf, where that covers several lines."""
    leaves = counted.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where((F.col("n") >= min_docs) & (F.col("lines") > 1))
    leaves = broadcast_if_small(written(leaves.select("leaf"), "leaves"))
    lines = texts.join(leaves, "leaf", "left_semi").groupBy("leaf", "hash", "line").agg(F.count("*").alias("n"))
    lines = written(lines.withColumnRenamed("leaf", "group"), "leaf-lines")
    found = []
    while not lines.isEmpty():
        done = written(_round(lines, similar, min_docs), "groups")
        found.append(done.where("template is not null").select("hash", "template"))
        rest = done.where("template is null and next is not null").select(F.col("next").alias("group"), "hash", "line", "n")
        on = rest.groupBy("group").agg(F.sum("n").alias("all"), F.count("*").alias("lines")).where((F.col("all") >= min_docs) & (F.col("lines") > 1))
        lines = written(rest.join(on.select("group"), "group", "left_semi"), "rest")
    if not found:
        return lines.select("hash", F.col("group").alias("template"))
    return reduce(DataFrame.unionByName, found)


def recurring_lines(docs: DataFrame, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The lines of all documents (id, h, hash), and of them the ones whose template recurs (hash, first: the id that keeps it).

    `docs` has id, h (a hash of the text) and text.
    """
    # masking is most of the work: it is done once, and only readers of the texts read their column
    texts = written(_lines(docs), "lines")
    lines = texts.select("id", "h", "leaf", "hash")
    counted = written(lines.groupBy("leaf", "hash").agg(F.count("*").alias("n"), F.min("id").alias("first")), "counted")
    member = written(_generalised(texts, counted, similar, min_docs), "members")
    few = broadcast_if_small(member)
    single = counted.where(F.col("n") >= min_docs).join(few, "hash", "left_anti").select("hash", "first")
    # a document with several lines of a template counts once
    of_template = lines.join(few, "hash").groupBy("template", "id", "h").agg(F.count("*").alias("lines"))
    rows = docs.groupBy("id", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    templates = (
        of_template.join(rows, of_template["id"].eqNullSafe(rows["id"]) & (of_template["h"] == rows["h"]), "left")
        .groupBy("template")
        .agg(F.sum(F.coalesce("rows", F.lit(1))).alias("n"), F.min(of_template["id"]).alias("first"))
        .where(F.col("n") >= min_docs)
    )
    shared = member.join(templates, "template").select("hash", "first")
    return lines.select("id", "h", "hash"), written(single.unionByName(shared), "recurring")


def drop_recurring_lines(
    docs: DataFrame, similar: float = SIMILAR, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns of `docs`, with the recurring lines taken out of `text`, and an array `dropped_lines` of them.

    A column of that name in `docs` is replaced.
    """
    body = F.col(text).cast("string")
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("h"), body.alias("text")).where("text is not null")
    lines, recurring = recurring_lines(own, similar, min_docs)
    dropped = lines.join(broadcast_if_small(recurring), "hash").where(~F.col("id").eqNullSafe(F.col("first")))
    dropped = dropped.groupBy("id", "h").agg(F.collect_set("hash").alias("hashes"))
    keys = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "dropped_lines"]).alias("row"), F.col(doc_id).alias("row_id"), F.xxhash64(body).alias("row_h"), body.alias("body"))
    rows = keys.join(dropped, keys["row_id"].eqNullSafe(dropped["id"]) & (keys["row_h"] == dropped["h"]), "left")
    gone = lambda line: F.array_contains("hashes", F.xxhash64(F.trim(masked(line))))
    marked = F.transform(F.split("body", "\n"), lambda x: F.struct(x.alias("line"), gone(x).alias("gone")))
    of = lambda lines, dropped: F.transform(F.filter(lines, lambda x: x["gone"] == dropped), lambda x: x["line"])
    parts = F.when(
        F.col("hashes").isNotNull(),
        let(marked, lambda lines: F.struct(F.array_join(of(lines, False), "\n").alias("text"), of(lines, True).alias("dropped"))),
    )
    rows = rows.select("row", "body", parts.alias("parts"))
    names = [c for c in docs.columns if c != "dropped_lines"]
    cols = [F.coalesce("parts.text", "body").alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return rows.select(*cols, F.coalesce("parts.dropped", F.array().cast("array<string>")).alias("dropped_lines"))
