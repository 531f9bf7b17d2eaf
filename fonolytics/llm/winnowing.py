"""Document fingerprints by winnowing.

The text's words (lower-cased runs of letters, digits and characters above
0x7F) are hashed in runs of `GRAM` words; of every `WINDOW` consecutive hashes
the smallest is kept, the rightmost of equal ones, with its word position. So
two texts that share `GRAM + WINDOW - 1` consecutive words share a kept hash,
and no shared run shorter than `GRAM` words can match.

A kept entry is one number: 35 bits of hash above 28 bits that count positions
downwards, so that the smaller number is the smaller hash, and of equal hashes
the later one. Built-in functions do all of it, one row at a time.

Results in special cases:
- a null text is an empty text; a text without words has no entries. Two texts
  without entries are alike (1), one with and one without are not (0).
- a text of fewer words than `GRAM` is one hash of all its words; one of fewer
  hashes than `WINDOW` is one window.
- equal texts have equal fingerprints, also in repeated rows.
- an empty table gives an empty result; whole texts are read (2^28 words).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fonolytics.llm.expressions import let, plain

GRAM = 3
WINDOW = 5
_PLACES = (1 << 28) - 1


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of kept entries (see the module), in order of position."""

    def packed(words: Column) -> Column:
        def entry(w: Column, i: Column) -> Column:
            h = F.xxhash64(w, *[F.get(words, i + j) for j in range(1, gram)])
            return F.shiftleft(F.shiftrightunsigned(h, 29), 28) + (F.lit(_PLACES) - i)

        whole = F.slice(F.transform(words, entry), F.lit(1), F.greatest(F.size(words) - (gram - 1), F.lit(1)))
        return F.when(words[0] != "", whole).otherwise(F.array().cast("array<bigint>"))

    def kept(entries: Column) -> Column:
        # the entry itself a second time: a window of one has no other
        least = F.transform(entries, lambda e, i: F.least(e, e, *[F.get(entries, i + j) for j in range(1, window)]))
        return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(entries) - (window - 1), F.lit(1))))

    return let(let(F.split(plain(text), " "), packed), kept)


def as_text(entries: Column) -> Column:
    """`hash@word position` of each entry, comma-joined."""
    one = lambda e: F.concat_ws("@", F.lower(F.hex(F.shiftright(e, 28))), (F.lit(_PLACES) - e.bitwiseAND(F.lit(_PLACES))).cast("string"))
    return F.array_join(F.transform(entries, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of common hashes over the sum of the numbers of different hashes (0 to 1)."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda e: F.shiftright(e, 28)))
    both = F.struct(hashes(a).alias("a"), hashes(b).alias("b"))
    share = lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 1.0).otherwise(
        2 * F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.size(s["a"]) + F.size(s["b"]), F.lit(1))
    )
    return let(both, share)


def with_next(docs: DataFrame, order: str, text: str, add: dict[str, Column] | None = None) -> DataFrame:
    """Each row with `next_text`, the text of the row with the next smaller `order` (after the smallest, the largest).

    `add` are expressions over (order, text) that each row gets, and with the prefix next_ those of its next row.
    Ties of `order` are ordered by a hash of the text; nulls come last.

    Rows are dealt to ranges of `order`. The ranges end at values that occur, so the row that
    follows a range's last one is known by its value, and a copy of it is dealt to that range too:
    each range is then ordered by itself. Only the ranges' ends reach the driver.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(order).cast("long").alias("at"), F.col(text).cast("string").alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = own.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q"), F.max("at").alias("top")).first()
    # the quantiles are approximate and may not occur: the largest value of each range does
    ends = _range_number(F.col("at"), sorted(set(cuts.q or [])))
    ends = sorted({r.end for r in own.where("at is not null").groupBy(ends.alias("r")).agg(F.max("at").alias("end")).collect()})
    number = F.when(F.col("at").isNull(), 0).otherwise(_range_number(F.col("at"), ends))
    rows = own.withColumn("range", number).withColumn("copy", F.lit(False))
    # the first row after range r is the largest one of range r - 1; after the lowest range comes the largest of all
    last = spark.createDataFrame([(e,) for e in ends], "at long")  # one row per range: small enough for every task
    copies = own.join(F.broadcast(last), "at").withColumn("range", F.pmod(number + 1, F.lit(max(len(ends), 1)))).withColumn("copy", F.lit(True))
    if not ends:  # all ids are null, or there are no rows: one order by text
        copies = rows.orderBy(F.xxhash64("text").desc(), "text").limit(1).withColumn("copy", F.lit(True))
    dealt = rows.unionByName(copies).select("range", "copy", "at", "text", F.xxhash64("text").alias("h"), *[c.alias(n) for n, c in (add or {}).items()])
    follow = Window.partitionBy("range").orderBy("copy", F.col("at").desc_nulls_last(), F.col("h").desc())
    added = [F.lead(n).over(follow).alias(f"next_{n}") for n in add or {}]
    return dealt.select("*", F.lead("text").over(follow).alias("next_text"), *added).where(~F.col("copy")).drop("copy", "range", "h")


def _range_number(value: Column, ends: list[int]) -> Column:
    """How many of the sorted `ends` are smaller than the value (binary search)."""
    if not ends:
        return F.lit(0)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]) if len(ends) < 64 else F.from_json(F.lit(str(ends)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    step = lambda b, n, s: F.when((n + s <= len(ends)) & (F.get(b, n + s - 1) < value), n + s).otherwise(n)
    return let(bounds, lambda b: reduce(lambda n, s: let(n, lambda m: step(b, m, s)), steps, F.lit(0)))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_chars, edited (its last half replaced by the beginning of the next text), the fingerprints of
    the text and the edited text, and their likeness (near_edited) and that of the next text (near_next)."""
    rows = with_next(docs, doc_id, text, {"entries": fingerprint(F.coalesce("text", F.lit("")), gram, window)})
    own, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.length(own) / 2).cast("int")
    edited = F.concat(F.substring(own, F.lit(1), F.length(own) - half), F.substring(following, F.lit(1), half))
    rows = rows.select("at", F.length(own).cast("long").alias("n_chars"), edited.alias("edited"), "entries", "next_entries")
    rows = rows.withColumn("edited_entries", fingerprint(F.col("edited"), gram, window))
    return rows.select(
        F.col("at").alias(doc_id),
        "n_chars",
        "edited",
        as_text(F.col("entries")).alias("fingerprint"),
        as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
