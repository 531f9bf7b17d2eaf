"""One written catalogue per unchanged input, and both attempt logs in one tagged table."""

from conftest import SF001
from fonolytics.config import FIXTURE_CONFIG
from fonolytics.plans.materialize import materialize_shared, release, scratch_count
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.fixtures import fixture_tables
from fonolytics.sources.tables import ContactTables, read_contact_tables


def test_equal_plans_share_one_copy_until_a_file_changes(spark, tmp_path):
    src = str(tmp_path / "codes")
    spark.createDataFrame([("A", "pdp")], "code string, kind string").write.parquet(src)
    plan = lambda kind="pdp": spark.read.parquet(src).where(f"kind = '{kind}'")
    before = scratch_count()
    one, two, other = materialize_shared(plan()), materialize_shared(plan()), materialize_shared(plan("x"))
    assert one.inputFiles() == two.inputFiles() and scratch_count() == before + 2
    assert other.count() == 0 and one.count() == 1
    spark.createDataFrame([("A", "pdp"), ("B", "pdp")], "code string, kind string").write.mode("overwrite").parquet(src)
    assert materialize_shared(plan()).count() == 2
    release(spark, before)
    assert materialize_shared(plan()).count() == 2  # written again after its copy was removed
    release(spark, before)


def test_rows_made_in_the_program_are_not_shared(spark):
    before = scratch_count()
    for n in (1, 2):
        assert materialize_shared(spark.createDataFrame([(i,) for i in range(n)], "a long")).count() == n
    release(spark, before)


def test_tagged_log_gives_the_same_stages_with_one_scan(spark):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    two = ContactStages(ContactTables(t.intentos, t.intentos_bkp, t.conclusiones, t.asignacion), FIXTURE_CONFIG)
    one = ContactStages(t, FIXTURE_CONFIG)
    for stage in ("attempts_once", "attempts_union", "d5_first_contacts"):
        a, b = getattr(one, stage), getattr(two, stage)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    scans = lambda s: s.d5_first_contacts._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")
    assert (scans(one), scans(two)) == (1, 2)


def test_reading_one_log_with_a_source_column(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    paths = {n: str(tmp_path / n) for n in ("registro", "conclusiones", "asignacion")}
    t.registro.write.partitionBy("fuente", "periodo").parquet(paths["registro"])
    t.conclusiones.write.parquet(paths["conclusiones"])
    t.asignacion.write.parquet(paths["asignacion"])
    read = read_contact_tables(spark, paths)
    assert (read.intentos.count(), read.intentos_bkp.count()) == (t.intentos.count(), t.intentos_bkp.count())
    a, b = ContactStages(read, FIXTURE_CONFIG).d12_profile, ContactStages(t, FIXTURE_CONFIG).d12_profile
    cols = sorted(b.columns)
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and a.count() == b.count()
