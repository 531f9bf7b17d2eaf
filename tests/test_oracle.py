"""Every registered query agrees with its DuckDB oracle on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from fonolytics.plans.catalog import all_oracle_sql, all_queries
from conftest import SF001

TABLES = ["orders", "lineitem", "customer", "events"]


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(hashlib.md5("|".join(_norm(r[i]) for i in order).encode()).hexdigest() for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(all_oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    df = all_queries()[key](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(all_oracle_sql()[key])
    d_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert _bag(s_rows, df.columns) == _bag(d_rows, rel.columns)


def test_every_query_has_an_oracle_or_is_listed():
    no_sql = set(all_queries()) - set(all_oracle_sql())
    assert set(all_queries()) <= set(E.queries()) and set(all_oracle_sql()) <= set(E.oracle_sql())
    assert no_sql <= {"first_contact_stream"}, no_sql


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "necesita_revision" in df.columns
    assert df.count() == 66  # FIXTURES.md section 3 at sf0.001
