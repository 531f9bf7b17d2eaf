"""Monthly files whose columns appear, vanish or change their type, read as one table.

The profile passes all columns of the assignment through (`c.*`), and the
table has no declared schema, so months differ: a column is added, a code that
was a number becomes text, an amount gets decimals, a name gets a blank or
capitals. Here each month keeps its own schema; the common one has every
column that any month has, under one stable name, with the narrowest type that
holds all its months' values. Only the schemas (one footer per month) are read
for that; each month is then scanned once, with its own filters and columns.

Rules: names are lower-cased, and runs of blanks, dots and hyphens become one
underscore (two columns of a month that meet under one name are an error, not
a guess). Whole numbers widen to the longer one, with fractions to double,
decimals to one that holds both, a date and a timestamp to timestamp; any other
mixture becomes text. A month without a column has nulls in it. Columns come
in the order of first appearance, months in ascending order, so a later month
never moves or renames an earlier column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fonolytics.sources.tables import ATTEMPT_RENAMES

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
# Decimal digits that hold each whole type.
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 20}


def stable_name(name: str) -> str:
    return ATTEMPT_RENAMES.get(name, re.sub(r"[\s.\-]+", "_", name.strip()).lower())


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    numbers = (*map(type, _WHOLE), T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            # a double holds whole numbers of 15 digits and floats; longer ones and decimals would lose digits
            safe = all(isinstance(x, (T.FloatType, T.DoubleType)) or _DIGITS.get(x, 99) <= 10 for x in (a, b))
            return T.DoubleType() if safe else T.StringType()
        parts = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (_DIGITS[x], 0) for x in (a, b)]
        whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """The common schema of months in order."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        names = [stable_name(f.name) for f in schema]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ValueError(f"columns that meet under one name: {sorted(twice)}")
        for f, name in zip(schema, names):
            kinds[name] = common_type(kinds[name], f.dataType) if name in kinds else f.dataType
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def union_months(months: list[DataFrame]) -> DataFrame:
    """The months' rows under their common schema."""
    if not months:
        raise ValueError("no months")
    common = merged_schema([m.schema for m in months])
    out = None
    for m in months:
        own = {stable_name(f.name): F.col(f"`{f.name}`") for f in m.schema}
        aligned = m.select(*[(own[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in common])
        out = aligned if out is None else out.unionByName(aligned)
    return out


def read_months(spark: SparkSession, paths: dict[str, str], month_column: str = "codmes", fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """One table from a folder or file per month (``paths``: month to location), months in ascending order.

    ``month_column`` is the month as text where a month's files lack it; a
    filter on it then leaves the other months' files unread.
    """
    frames = []
    for month in sorted(paths):
        df = spark.read.format(fmt).options(**(options or {})).load(paths[month])
        if month_column not in [stable_name(c) for c in df.columns]:
            df = df.withColumn(month_column, F.lit(month))
        frames.append(df)
    return union_months(frames)
