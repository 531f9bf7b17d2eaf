"""Column expressions that the operators on built-in functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs between words, in lower-cased text: words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of a text, lower-cased, one blank between them; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_WORDS, " "))


def n_words(words: Column) -> Column:
    """Number of words of a `plain` text."""
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, however often `use` names it (also in lambdas)."""
    return F.transform(F.array(value), use)[0]
