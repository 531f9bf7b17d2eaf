"""Queries that SQL can express, against DuckDB."""

import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward, write_tables  # noqa: E402

from fonolytics.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

LICENSED = [
    (1, "x\nReleased under the MIT License.\ny under the mit license"),
    (2, "Licensed under the Apache License, Version 2.0. Apache license version 2!"),
    (3, "cc by nc cc by nc\ncc-by-nc"),
    (4, "under the MIT licensee\nthe mit"),
    (5, "All rights reserved"),
    (6, "rights\nall reserved"),
    (7, None),
    (8, "permission granted free of charge to any person obtaining a copy of this software and associated documentation"),
    (9, "apacheélicense version 2\nlicense under gnu general public the this work is version 9"),
    (9, "apacheélicense version 2\nlicense under gnu general public the this work is version 9"),
    (None, "CC BY-NC"),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    bench = [(1, None), (3, "quick brown fox"), (None, "lazy dog"), (4, "forest")]
    one = write_tables(spark, str(tmp_path_factory.mktemp("one")), awkward(spark), bench)
    two = write_tables(spark, str(tmp_path_factory.mktemp("two")), awkward(spark, LICENSED), bench)
    return ["/root/testdata/sf0.01", one, two]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, folders, name):
    for folder in folders:
        con = duckdb.connect()
        for p in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        df = QUERIES[name](spark, folder)
        cols = sorted(df.columns)
        want = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key)
