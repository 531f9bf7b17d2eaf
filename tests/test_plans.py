"""Physical-plan properties the stages are written for."""

from conftest import SF001
from fonolytics.plans.catalog import stages_for


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_catalogue_is_broadcast_by_its_written_size(spark):
    plan = _plan(stages_for(spark, SF001).d2_live)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [wrap_up" not in plan


def test_first_contact_is_an_aggregate_not_a_window(spark):
    plan = _plan(stages_for(spark, SF001).d5_first_contacts)
    assert "Window" not in plan
    assert "Aggregate" in plan


def test_unpivots_are_generators(spark):
    p = stages_for(spark, SF001, base="checkpoint")
    for df in (p.d13_contact_phones, p.d14_assigned_phones):
        plan = _plan(df)
        assert "Generate" in plan and "Union" not in plan


def _nodes(df, *names) -> int:
    return sum(_plan(df).count(n) for n in names)


def test_alerts_need_no_join_or_exchange_after_the_profile(spark):
    p = stages_for(spark, SF001)
    work = ("Exchange ", "SortMergeJoin", "BroadcastHashJoin")
    assert _nodes(p.d22_profile_alerts, *work) == _nodes(p.d12_profile, *work)
    assert _nodes(p.d17_alerts(ordered=False), *work) == _nodes(p.d12_profile, *work)
    opt = p.d22_profile_alerts._jdf.queryExecution().optimizedPlan().toString()
    assert len(opt.splitlines()) < 120, len(opt.splitlines())


def test_alerts_carry_no_other_assignment_column(spark):
    assert "saldo" not in stages_for(spark, SF001).facts.columns


def test_presence_has_one_exchange(spark):
    assert _plan(stages_for(spark, SF001).d7_presence).count("Exchange ") == 1


def test_scans_read_only_needed_columns(spark):
    plan = _plan(stages_for(spark, SF001).d7_presence)
    # the presence matrix needs client, date and priority of orders only
    assert "o_totalprice" not in plan


def test_large_catalogue_takes_the_same_path(spark):
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.plans.stages import ContactStages
    from fonolytics.sources.fixtures import fixture_tables
    from fonolytics.sources.tables import ContactTables
    from pyspark.sql import functions as F

    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    more = spark.range(60_000).select(F.concat(F.lit("x"), "id").alias("conlusion_cloud"), F.lit("pdp").alias("tipo_resultado"))
    large = ContactTables(t.intentos, t.intentos_bkp, t.conclusiones.unionByName(more), t.asignacion)
    a, b = ContactStages(t, FIXTURE_CONFIG), ContactStages(large, FIXTURE_CONFIG)
    for x, y in ((a.d5_first_contacts, b.d5_first_contacts), (a.attempts_union, b.attempts_union)):
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_session_checkpoint_dir_is_respected(spark):
    from fonolytics.plans.materialize import checkpoint_dir, ensure_checkpoint_dir

    before = checkpoint_dir(spark)
    assert before and ensure_checkpoint_dir(spark, "/nonexistent/should/not/be/used") == spark.sparkContext.getCheckpointDir()


FORBIDDEN = ["SinglePartition", "BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]


def test_no_registered_plan_funnels_or_crosses(spark):
    """No query gathers everything into one partition, cross-joins or runs
    per-row Python, also when no side may be broadcast (the large-table shape)."""
    from fonolytics.plans.catalog import all_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key, build in all_queries().items():
            plan = _plan(build(spark, SF001))
            assert not [w for w in FORBIDDEN if w in plan], key
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
