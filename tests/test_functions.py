"""Column helpers against plain-Python definitions (property tests, batched per example)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fonolytics.functions.phones import clean_phone, last_digits, position_list

texts = st.one_of(st.none(), st.text(alphabet="0123456789 -", max_size=14))


@settings(max_examples=8, deadline=None, derandomize=True, database=None)
@given(st.lists(texts, min_size=1, max_size=40), st.integers(min_value=1, max_value=12))
def test_last_digits_is_right(spark, values, n):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", last_digits("s", n).alias("d")).collect()}
    assert got == {i: (None if v is None else v[-n:]) for i, v in enumerate(values)}


@settings(max_examples=8, deadline=None, derandomize=True, database=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_clean_phone_only_exact_zero(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", clean_phone("s").alias("c")).collect()}
    assert got == {i: (None if v == "0" else v) for i, v in enumerate(values)}


@settings(max_examples=8, deadline=None, derandomize=True, database=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 12)), min_size=1, max_size=60))
def test_position_lists(spark, pairs):
    df = spark.createDataFrame(pairs, "k int, pos int")
    text = {r.k: r.p for r in df.groupBy("k").agg(position_list(F.col("pos")).alias("p")).collect()}
    num = {r.k: r.p for r in df.groupBy("k").agg(position_list(F.col("pos"), numeric=True).alias("p")).collect()}
    for k in {k for k, _ in pairs}:
        ps = {p for kk, p in pairs if kk == k}
        assert text[k] == ",".join(sorted(str(p) for p in ps))
        assert num[k] == ",".join(str(p) for p in sorted(ps))
