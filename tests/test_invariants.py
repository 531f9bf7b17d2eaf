"""Invariants of SURVEY 5.3 on the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from fonolytics.config import FIXTURE_CONFIG
from fonolytics.plans.catalog import stages_for


@pytest.fixture(scope="module")
def p(spark):
    return stages_for(spark, SF01)


def test_assigned_phones_split_into_matched_and_a3(p):
    matched = p.d14_assigned_phones.join(
        p.d13_contact_phones.withColumnRenamed("telefono_ce", "telefono").select("codunicocli", "telefono").distinct(),
        ["codunicocli", "telefono"], "left_semi").count()
    assert p.d14_assigned_phones.count() == matched + p.d16_dead.count() == 3192


def test_summary_counts_equal_grouped_alerts(p):
    alerts = p.d17_alerts(ordered=False)
    by_type = {r.tipo_alerta: r["count"] for r in alerts.groupBy("tipo_alerta").count().collect()}
    s = p.d18_summary(ordered=False).agg(
        F.sum("cant_A1_score_mal_priorizado"), F.sum("cant_A2_telefono_no_asignado"), F.sum("cant_A3_telefono_sin_contacto")
    ).first()
    assert tuple(s) == (by_type["A1_SCORE_MAL_PRIORIZADO"], by_type["A2_TELEFONO_NO_ASIGNADO"], by_type["A3_TELEFONO_SIN_CONTACTO"])
    sev = p.d18_summary(ordered=False)
    assert sev.where((F.col("ranking_gravedad") == 1) != (F.col("cant_A2_telefono_no_asignado") > 0)).count() == 0
    assert {r.ranking_gravedad: r["count"] for r in sev.groupBy("ranking_gravedad").count().collect()} == {1: 426, 2: 73, 3: 6}


def test_flagged_clients_are_the_summary_clients(p):
    si = {r.codunicocli for r in p.d22_profile_alerts.where("necesita_revision = 'SI'").select("codunicocli").collect()}
    summ = {r.codunicocli for r in p.d18_summary(ordered=False).select("codunicocli").collect()}
    assert si == {c for c in summ if c is not None}


def test_month_cells_count_assigned_months(p):
    cells = sum((F.col(label).isNotNull().cast("int") for label in FIXTURE_CONFIG.labels), F.lit(0))
    prof = p.d12_profile
    assert prof.where(cells != F.col("meses_con_gestion")).count() == 0
    assert prof.where(F.col(FIXTURE_CONFIG.target_label).isNull()).count() == 0


def test_dedup_gives_one_row_per_client(spark, p):
    assert p.d12_profile.count() == 655
    d = stages_for(spark, SF01, FIXTURE_CONFIG.with_(dedup=True))
    prof = d.d12_profile
    assert prof.count() == prof.select("codunicocli").distinct().count() == 558


def test_result_does_not_depend_on_input_partitioning(spark, p):
    from fonolytics.plans.stages import ContactStages
    from fonolytics.sources.fixtures import fixture_tables

    t = fixture_tables(spark, SF01, FIXTURE_CONFIG)
    shuffled = type(t)(
        intentos=t.intentos.repartition(13),
        intentos_bkp=t.intentos_bkp.repartition(5),
        conclusiones=t.conclusiones,
        asignacion=t.asignacion.repartition(7),
    )
    a = p.d22_profile_alerts
    b = ContactStages(shuffled, FIXTURE_CONFIG).d22_profile_alerts
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_report_equals_the_joined_alert_tables(p):
    from pyspark.sql import functions as F

    tables = {"A1_score_mal_priorizado": p.d19_a1, "A3_telefono_sin_contacto": p.d21_a3}
    got = p.d22_profile_alerts
    for column, table in tables.items():
        want = p.base.join(table, "codunicocli", "left").select("codunicocli", F.coalesce(F.concat(F.lit("SI - pos "), "posiciones"), F.lit("NO")))
        have = got.select("codunicocli", column)
        assert have.exceptAll(want).count() == 0 and want.exceptAll(have).count() == 0
