"""Presence from stored month bitmaps equals D7; a new month reads that month only."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from fonolytics.config import FIXTURE_CONFIG as CFG
from fonolytics.operators.assignment import presence_matrix
from fonolytics.plans.month_bitmaps import (
    BITS, assigned_clients, month_bitmaps, presence_from_bitmaps, read_bitmaps, refresh_bitmaps,
)
from fonolytics.sources.fixtures import assignment_history
from fonolytics.sources.tables import string_partitions

SCHEMA = "codunicocli long, codmes string, tramo_asignacion string"


def _same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ids_at_the_edges_of_blocks(spark):
    ids = [None, 0, 1, -1, BITS - 1, BITS, BITS + 1, -BITS, -BITS - 1, 10**12]
    rows = [(c, m, "temprana") for i, c in enumerate(ids) for m in CFG.periods[i % 3 :: 3]]
    rows += [(1, CFG.periods[0], "temprana"), (7, CFG.periods[0], "judicial"), (8, "199801x", "tardia"), (9, "199001", "tardia"), (10, None, "tardia")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _same(presence_from_bitmaps(month_bitmaps(df, CFG), CFG), presence_matrix(df, CFG))
    assert presence_from_bitmaps(month_bitmaps(df.limit(0), CFG), CFG).count() == 0


def test_rows_carry_words_instead_of_bitmaps(spark):
    """Blocks with few, many and all places set; no row that is made per place carries a block's bitmaps along."""
    ids = [*range(1, BITS + 1), *range(BITS + 1, 3 * BITS, 37), 10 * BITS + 5, -40, -70 * BITS]
    rows = spark.createDataFrame([(c, k) for k, c in enumerate(ids)], "c long, k long")
    df = rows.select(F.col("c").alias("codunicocli"), F.explode(F.slice(F.array(*map(F.lit, CFG.periods)), (F.col("k") % 7 + 1).cast("int"), 2)).alias("codmes"), F.lit("tardia").alias("tramo_asignacion"))
    found = presence_from_bitmaps(month_bitmaps(df, CFG), CFG)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    assert len(gathered) == 1 and "palabra" in gathered[0] and "mapa" not in gathered[0], plan
    assert found.count() == len(ids) and _same(found, presence_matrix(df, CFG))


def test_a_new_month_reads_that_month_only(spark, tmp_path):
    src, store = str(tmp_path / "asignacion"), str(tmp_path / "store")
    assignment_history(spark, SF001).write.partitionBy("codmes").parquet(src)
    with string_partitions(spark):
        stored = spark.read.parquet(src)
    old, new = CFG.periods[:-1], CFG.periods[-1]
    assert refresh_bitmaps(stored, CFG, store, old) == sorted(old)
    # the old months are gone from the source: only the new one is read now
    fewer = stored.where(F.col("codmes") == new)
    assert refresh_bitmaps(fewer, CFG, store, CFG.periods) == [new]
    assert refresh_bitmaps(fewer, CFG, store, CFG.periods) == []
    assert _same(presence_from_bitmaps(read_bitmaps(spark, CFG, store), CFG), presence_matrix(stored.where(F.col("codmes").isin(list(CFG.periods))), CFG))
    plan = month_bitmaps(stored.where(F.col("codmes").isin([new])), CFG)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{new}", plan), plan
    # a month that is done again replaces its bitmaps
    assert refresh_bitmaps(stored.limit(0), CFG, store, CFG.periods, recompute=[new]) == [new]
    assert read_bitmaps(spark, CFG, store).where(F.col("codmes") == new).count() == 0


def test_other_stages_use_another_part(spark, tmp_path):
    df, store = spark.createDataFrame([(1, CFG.periods[0], "temprana"), (2, CFG.periods[0], "judicial")], SCHEMA), str(tmp_path / "s")
    other = CFG.with_(stages=("judicial",))
    for cfg, want in ((CFG, 1), (other, 2)):
        refresh_bitmaps(df, cfg, store, CFG.periods)
        assert [r.cu for r in presence_from_bitmaps(read_bitmaps(spark, cfg, store), cfg).collect()] == [want]


def test_distinct_clients_over_months(spark):
    rows = [(1, "199701", "tardia"), (1, "199701", "tardia"), (2, "199701", "tardia"), (2, "199702", "tardia"), (40000, "199702", "tardia"), (None, "199702", "tardia")]
    got = sorted(tuple(r) for r in assigned_clients(month_bitmaps(spark.createDataFrame(rows, SCHEMA), CFG), ["199701", "199702"]).collect())
    assert got == [("199701", 2, 2), ("199702", 2, 3)]
