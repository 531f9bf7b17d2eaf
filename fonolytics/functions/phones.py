"""Column expressions for phones, month cells and position lists.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fonolytics.config import EMPTY_PHONE


def last_digits(col: Column | str, n: int) -> Column:
    """``right(s, n)``: strings shorter than ``n`` come back whole, null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.right(c.cast("string"), F.lit(n))


def phone_key(col: Column | str, digits: int | None = None) -> Column:
    """Phone as a comparable string (phones are compared as strings, S16).

    With ``digits`` the assigned side is cut the same way as the dialled
    number (the normalisation option for S15).
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return last_digits(c, digits) if digits else c


def clean_phone(col: Column | str, empty: str = EMPTY_PHONE) -> Column:
    """Slot value, or null when its text is exactly the empty marker."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.cast("string") == F.lit(empty), F.lit(None)).otherwise(c)


def month_cell(present: Column, result: Column, default: str) -> Column:
    """Null when the client was not assigned that month, else result or default."""
    return F.when(present == 1, F.coalesce(result, F.lit(default)))


def month_phone(present: Column, phone: Column) -> Column:
    """The phone used that month, masked like the month cell."""
    return F.when(present == 1, phone)


def position_list(positions: Column, numeric: bool = False) -> Column:
    """Distinct positions joined by commas, sorted as text ("1,10,2", S17)
    or, with ``numeric``, as numbers ("1,2,10").

    ``positions`` must be an aggregate-ready integer column; the set holds at
    most one entry per phone slot, so it is bounded by the slot count.
    """
    return joined_positions(F.collect_set(positions), numeric)


def joined_positions(positions: Column, numeric: bool = False) -> Column:
    """An array of distinct positions as ``position_list`` shows it."""
    if numeric:
        return F.array_join(F.transform(F.array_sort(positions), lambda x: x.cast("string")), ",")
    return F.array_join(F.array_sort(F.transform(positions, lambda x: x.cast("string"))), ",")


def first_row(*order_and_payload: Column) -> Column:
    """``min(struct(...))``: the smallest row by the leading fields.

    A struct compares field by field with nulls first, the same order as an
    ascending ``row_number`` window, but it aggregates partially on the map
    side, so a hot group never reaches one task whole.
    """
    return F.min(F.struct(*order_and_payload))
