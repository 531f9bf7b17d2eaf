"""The stored client 360: looked up by each kind of identifier, without reading the rest of the store."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fonolytics.plans.jobs import q_client_360, q_client_products
from fonolytics.sources import fixtures as fx
from fonolytics.sources.lookup_store import CLIENTS, IDENTIFIERS, LookupStore, identifiers_of, write_lookup_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    write_lookup_store(fx.client_identifiers(spark, SF01), q_client_360(spark, SF01), q_client_products(spark, SF01), path, "c_custkey", files=8)
    return LookupStore(spark, path, "c_custkey")


def test_each_kind_of_identifier(spark, store):
    doc = f"{700 * 7919 + 10000019:012d}"
    got = store.clients([("CU", "700"), ("DOC", doc), ("CU", "nobody"), ("CJ", doc)]).collect()
    assert sorted((r.tipo, r.c_custkey) for r in got) == [("CU", 700), ("DOC", 700)]
    want = q_client_360(spark, SF01).where("c_custkey = 700").first()
    assert {(r.n_productos, r.deuda_total) for r in got} == {(want.n_productos, want.deuda_total)}
    # a CJ code stands for several clients
    members = fx.table(spark, SF01, "customer").where((F.col("c_mktsegment") == fx.CJ_SEGMENT) & (F.col("c_nationkey") == 3))
    assert sorted(r.c_custkey for r in store.clients([("CJ", "J3")]).collect()) == sorted(r.c_custkey for r in members.collect())
    lines = store.products([("DOC", doc)])
    assert lines.count() == want.n_productos and {r.c_custkey for r in lines.collect()} == {700}


def _scanned(df):
    """Rows that the scans of an executed plan read."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    stack = [leaves.apply(i) for i in range(leaves.size())]
    for leaf in stack:
        name = leaf.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            inner = leaf.executedPlan().collectLeaves()
            stack += [inner.apply(i) for i in range(inner.size())]
        elif "QueryStage" in name:
            inner = leaf.plan().collectLeaves()
            stack += [inner.apply(i) for i in range(inner.size())]
        elif name.startswith("Scan parquet"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_a_look_up_skips_most_of_the_store(spark, store):
    clients, ids = store._table(CLIENTS).count(), store._table(IDENTIFIERS).count()
    assert (clients, ids > 3000) == (1500, True)
    one = store.found([("CU", "700")])
    assert one.count() == 1 and 0 < _scanned(one) < ids / 3
    row = store._table(CLIENTS).where("c_custkey = 700")
    assert 0 < _scanned(row) < clients / 3


def test_values_between_those_of_a_file_are_skipped_by_its_bloom_filter(spark, store):
    # in the range of the stored document numbers, but none of them
    absent = store._table(IDENTIFIERS).where((F.col("tipo") == "DOC") & (F.col("valor") == f"{700 * 7919 + 10000020:012d}"))
    assert "valor" in absent._jdf.queryExecution().executedPlan().toString() and absent.count() == 0
    assert _scanned(absent) == 0


def test_many_identifiers_go_through_a_join(spark, store):
    everyone = [("CU", str(i)) for i in range(1500)]
    assert store.clients(everyone).count() == 1500
    table = spark.range(1500).select(F.lit("CU").alias("tipo"), F.col("id").alias("valor"))
    assert store.clients(table).count() == 1500


def test_nulls_and_repeated_identifiers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "z"), (None, "q", "z"), (3, "a", "y")], "k long, d string, j string")
    ids = identifiers_of(rows, "k", {"D": "d", "J": "j"})
    assert sorted(tuple(r) for r in ids.collect()) == [("D", "a", 1), ("D", "a", 3), ("J", "y", 3), ("J", "z", 2)]
    clients = rows.select("k").distinct()
    write_lookup_store(ids, clients, clients.limit(0).withColumn("v", F.lit(1)), str(tmp_path / "s"), "k", files=2)
    s = LookupStore(spark, str(tmp_path / "s"), "k")
    assert sorted(r.k for r in s.clients([("D", "a")]).collect()) == [1, 3] and s.products([("D", "a")]).count() == 0
    assert s.clients([]).count() == 0
