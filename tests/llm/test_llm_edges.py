"""Every operator's query and the pipeline on awkward rows and on empty tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import VECTORS, awkward, write_tables  # noqa: E402

from fonolytics.llm.queries import QUERIES  # noqa: E402

BENCH = [(1, None), (2, ""), (3, "quick brown fox"), (4, "never there at all in any of the texts no no"), (None, "lazy dog"), (3, "quick brown fox")]
LABELS = [(6, 1, 1), (5, 1, 0), (None, 1, 1), (7, 1, None), (99, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    full = write_tables(spark, str(tmp_path_factory.mktemp("full")), awkward(spark), BENCH, LABELS, VECTORS)
    none = write_tables(spark, str(tmp_path_factory.mktemp("none")), awkward(spark, []))
    return full, none


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows_keep_every_row(spark, tables, name):
    rows = QUERIES[name](spark, tables[0]).collect()
    if name.startswith("op9"):
        assert sorted((r.doc_id or 0) for r in rows if r.piece == 0) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    elif name.startswith("op13"):
        assert sorted((r.vec_id, r.component) for r in rows) == [(v, c) for v in range(3) for c in (1, 2)]
    else:
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).collect() == []


def test_pipeline_on_awkward_and_empty_tables(spark, tables):
    import corpus_pipeline

    names = spark.read.parquet(f"{tables[0]}/documents.parquet").columns
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables[0])
        assert docs.columns == names, name
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    # no text or letters: 1 to 4; copies of 6: the other 6 and 9; a benchmark passage: the rest of the prose
    assert {r.doc_id for r in rows} == {5, 7, 8}
    assert corpus_pipeline.run(spark, tables[1]).collect() == []
