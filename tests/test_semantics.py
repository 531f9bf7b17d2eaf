"""Hand-written rows for the behaviours of SURVEY 2.4 the test tables lack."""

from pyspark.sql import types as T

from fonolytics.config import ALERT_A1, ALERT_A2, ALERT_A3, ProfileConfig
from fonolytics.plans.stages import ContactStages
from helpers import CFG, assign, attempt, rows, tables, ts

P = "51900000001"   # dialled numbers; last 9 digits = 900000001 ...


def pipe(t, cfg=CFG):
    return ContactStages(t, cfg)


def test_duplicate_outcome_code(spark):  # S3
    # the scripts inner-join the catalogue: a code listed twice doubles its
    # attempts in the attempt lists, and the first contact drops the copy
    live = [attempt("202603", 1, "CE", P, ts(1)), attempt("202603", 1, "PDP", P, ts(2), 2)]
    asig = [assign(1, "202603", (900000001, 0, 0))]
    once = pipe(tables(spark, live=live, asig=asig))
    twice = pipe(tables(spark, live=live, asig=asig,
                        outcomes=[("CE", "contacto - efectivo"), ("CE", "contacto - efectivo"), ("PDP", "pdp")]))
    cols = ("fuente", "mes", "cu", "wrap_up", "telefono", "orden")
    assert rows(twice.d2_live, "wrap_up") == [("CE",), ("CE",), ("PDP",)]
    assert rows(twice.d4_effective_attempts, "wrap_up", "orden") == [("CE", 1), ("CE", 2), ("PDP", 3)]
    assert rows(once.d5_first_contacts, *cols) == rows(twice.d5_first_contacts, *cols)
    assert rows(once.d22_profile_alerts, "necesita_revision", "marzo") == rows(twice.d22_profile_alerts, "necesita_revision", "marzo")


def test_time_ties_are_broken_by_attempt_id_then_number(spark):  # S4
    live = [attempt("202603", 1, "CE", "51900000002", ts(1), 7), attempt("202603", 1, "CE", "51900000001", ts(1), 7)]
    p = pipe(tables(spark, live=live))
    assert rows(p.d5_first_contacts, "cu", "telefono") == [(1, "900000001")]
    assert rows(p.d4_effective_attempts, "telefono", "orden") == [("900000001", 1), ("900000002", 2)]


def test_non_numeric_backup_period_is_dropped(spark):  # S6
    bkp = [attempt("x", 1, "CE", P, ts(1)), attempt("202601", 1, "CE", P, ts(1))]
    p = pipe(tables(spark, bkp=bkp))
    assert rows(p.d3_backup, "mes") == [("202601",)]


def test_live_arm_has_no_lower_bound(spark):  # S7
    live = [attempt("202001", 1, "CE", P, ts(1))]
    p = pipe(tables(spark, live=live))
    assert rows(p.d2_live, "mes") == [("202001",)]


def test_campaign_and_outcome_filters(spark):
    live = [attempt("202603", 1, "CE", P, ts(1), campaign="otra"), attempt("202603", 2, "NC", P, ts(1)),
            attempt("202603", 3, "CE", P, ts(1))]
    p = pipe(tables(spark, live=live))
    assert rows(p.d2_live, "cu") == [(3,)]


def test_contact_in_unassigned_month_is_masked_and_phone_stays_a3(spark):  # S8
    live = [attempt("202601", 1, "CE", P, ts(1))]
    asig = [assign(1, "202603", (900000001, 0, 0))]
    p = pipe(tables(spark, live=live, asig=asig))
    prof = p.d12_profile.collect()[0]
    assert prof["enero"] is None and prof["enero_tlf"] is None and prof["marzo"] == "nc"
    assert rows(p.d17_alerts(), "tipo_alerta", "posicion_en_asignacion") == [(ALERT_A3, 1)]


def test_only_first_contact_of_a_month_counts(spark):  # S9
    live = [attempt("202603", 1, "CE", P, ts(1)), attempt("202603", 1, "CE", "51900000002", ts(2), 2)]
    asig = [assign(1, "202603", (900000001, 900000002, 0))]
    p = pipe(tables(spark, live=live, asig=asig))
    assert rows(p.d17_alerts(), "tipo_alerta", "posicion_en_asignacion") == [(ALERT_A3, 2)]


def test_target_month_summary_and_best_phone(spark):  # S10, S11, S12
    live = [attempt("202603", 1, "CE", P, ts(1))]
    asig = [assign(1, "202603", (900000001, 0, 0)), assign(1, "202601", (0, 0, 0), ida=2),
            assign(2, "202603", (900000005, 0, 0), ida=3)]
    p = pipe(tables(spark, live=live, asig=asig))
    got = {r["codunicocli"]: r for r in p.d12_profile.collect()}
    assert got[1]["resultado_marzo_resumen"] == "contacto" and got[1]["tlf_mejor_resultado"] == "900000001"
    assert got[1]["meses_con_gestion"] == 2 and got[1]["enero"] == "nc" and got[1]["febrero"] is None
    assert got[2]["resultado_marzo_resumen"] == "sin contacto" and got[2]["marzo"] == "nc"


def test_same_phone_in_two_slots_gives_ok_and_a1(spark):  # S13
    live = [attempt("202603", 1, "CE", P, ts(1))]
    asig = [assign(1, "202603", (900000001, 900000009, 900000001))]
    p = pipe(tables(spark, live=live, asig=asig))
    assert rows(p.d15_priority, "tipo_alerta", "posicion_en_asignacion") == [(ALERT_A1, 3), ("ok", 1)]
    assert rows(p.d22_profile_alerts, "A1_score_mal_priorizado", "A3_telefono_sin_contacto") == [("SI - pos 3", "SI - pos 2")]


def test_only_exact_zero_is_an_empty_slot(spark):  # S14
    asig = [assign(1, "202603", ("", "0", "00"))]
    p = pipe(tables(spark, asig=asig, phone_type=T.StringType()))
    prof = p.d12_profile.collect()[0]
    assert (prof["tlf1_limpio"], prof["tlf2_limpio"], prof["tlf3_limpio"]) == ("", None, "00")
    assert rows(p.d17_alerts(), "posicion_en_asignacion", "telefono") == [(1, ""), (3, "00")]


def test_prefixed_assigned_phone_never_matches_unless_normalised(spark):  # S15
    live = [attempt("202603", 1, "CE", "51900000101", ts(1))]
    asig = [assign(1, "202603", (51900000101, 0, 0))]
    t = tables(spark, live=live, asig=asig)
    assert rows(pipe(t).d17_alerts(), "tipo_alerta") == [(ALERT_A2,), (ALERT_A3,)]
    p = pipe(t, CFG.with_(normalise_phones=True))
    assert rows(p.d15_priority, "tipo_alerta") == [("ok",)]
    assert p.d17_alerts().count() == 0


def test_phones_compare_as_strings(spark):  # S16
    live = [attempt("202603", 1, "CE", "51900000101", ts(1))]
    asig = [assign(1, "202603", ("0900000101", "0", "0"))]
    p = pipe(tables(spark, live=live, asig=asig, phone_type=T.StringType()))
    assert rows(p.d17_alerts(), "tipo_alerta") == [(ALERT_A2,), (ALERT_A3,)]


def test_positions_sort_as_text_by_default(spark):  # S17
    cfg = CFG.with_(n_phones=10)
    phones = tuple(900000000 + k for k in range(1, 11))
    asig = [assign(1, "202603", phones)]
    live = [attempt("202603", 1, "CE", f"51{900000000 + k}", ts(1), k) for k in ()]
    t = tables(spark, live=live, asig=asig, n_phones=10)
    assert rows(pipe(t, cfg).d21_a3, "posiciones") == [("1,10,2,3,4,5,6,7,8,9",)]
    assert rows(pipe(t, cfg.with_(numeric_positions=True)).d21_a3, "posiciones") == [("1,2,3,4,5,6,7,8,9,10",)]


def test_alert_list_order(spark):  # S18
    cfg = ProfileConfig(periods=("202601", "202602"), labels=("enero", "abril"), backup_min_period=202601, n_phones=3)
    live = [attempt("202601", 1, "CE", "51900000007", ts(1)), attempt("202602", 1, "CE", "51900000008", ts(2), 2)]
    asig = [assign(1, "202601", (0, 0, 0)), assign(1, "202602", (0, 0, 0), ida=2)]
    p = pipe(tables(spark, live=live, asig=asig), cfg)
    assert [r["mes_alerta"] for r in p.d17_alerts().collect()] == ["abril", "enero"]


def test_summary_flags_and_severity(spark):  # S19
    live = [attempt("202603", 1, "CE", "51900000009", ts(1))]
    asig = [assign(1, "202603", (900000001, 0, 0)), assign(2, "202603", (0, 0, 0), ida=2)]
    p = pipe(tables(spark, live=live, asig=asig))
    s = p.d18_summary().collect()
    assert [(r.codunicocli, r.necesita_revision, r.cant_A1_score_mal_priorizado, r.cant_A2_telefono_no_asignado,
             r.cant_A3_telefono_sin_contacto, r.ranking_gravedad) for r in s] == [(1, "SI", 0, 1, 1, 1)]
    flags = dict(rows(p.d22_profile_alerts, "codunicocli", "necesita_revision"))
    assert flags == {1: "SI", 2: "NO"}


def test_null_client(spark):  # S20
    asig = [assign(None, "202603", (900000001, 0, 0)), assign(None, "202603", (900000002, 0, 0), ida=2)]
    live = [attempt("202603", None, "CE", P, ts(1))]
    p = pipe(tables(spark, live=live, asig=asig))
    prof = p.d12_profile.collect()
    assert len(prof) == 1 and prof[0]["meses_con_gestion"] == 0 and prof[0]["marzo"] is None
    assert rows(p.d17_alerts(), "codunicocli", "tipo_alerta") == [(None, ALERT_A3)]
    assert rows(p.d22_profile_alerts, "necesita_revision") == [("NO",)]


def test_duplicate_target_contact_duplicates_profile_rows(spark):  # S1, S2
    live = [attempt("202603", 1, "CE", "51900000001", ts(2))]
    bkp = [attempt("202603", 1, "CE", "51900000002", ts(1), 2)]
    asig = [assign(1, "202603", (900000001, 900000002, 0))]
    t = tables(spark, live=live, bkp=bkp, asig=asig)
    p = pipe(t)
    assert p.d12_profile.count() == 2
    # the month cell keeps the larger phone string, not the earlier call
    assert {r["marzo_tlf"] for r in p.d12_profile.collect()} == {"900000002"}
    d = pipe(t, CFG.with_(dedup=True))
    prof = d.d12_profile.collect()
    assert len(prof) == 1 and prof[0]["tlf_mejor_resultado"] == "900000002"


def test_stage_text_is_binary_unless_normalised(spark):  # S24
    asig = [assign(1, "202603", (900000001, 0, 0), tramo="Temprana ")]
    t = tables(spark, asig=asig)
    assert pipe(t).d12_profile.count() == 0
    assert pipe(t, CFG.with_(normalise_text=True)).d12_profile.count() == 1


def test_snapshot_keeps_rn_and_smallest_assignment(spark):  # S5, S25
    asig = [assign(1, "202603", (900000001, 0, 0), ida=9), assign(1, "202603", (900000002, 0, 0), ida=3)]
    p = pipe(tables(spark, asig=asig))
    r = p.d12_profile.collect()
    assert len(r) == 1 and r[0]["rn"] == 1 and r[0]["id_asignacion"] == 3 and r[0]["telefono1"] == 900000002


def test_extra_assignment_columns_pass_through(spark):  # c.* (P9)
    from pyspark.sql import functions as F

    asig = [assign(1, "202603", (900000001, 0, 0))]
    t = tables(spark, asig=asig)
    t = type(t)(t.intentos, t.intentos_bkp, t.conclusiones, t.asignacion.withColumn("segmento", F.lit("pyme")))
    p = pipe(t)
    cols = p.d22_profile_alerts.columns
    assert cols[:cols.index("rn") + 1][-2:] == ["segmento", "rn"]
    assert p.d22_profile_alerts.first()["segmento"] == "pyme"


def test_normalised_text_also_normalises_the_configured_lists(spark):  # S24
    live = [attempt("202603", 1, " ce ", P, ts(1), campaign="COB_BPE_00")]
    asig = [assign(1, "202603", (900000001, 0, 0), tramo="Temprana")]
    cfg = CFG.with_(normalise_text=True, stages=("TEMPRANA",), campaigns=("Cob_Bpe_00",))
    p = pipe(tables(spark, live=live, asig=asig), cfg)
    assert rows(p.d12_profile, "marzo", "tlf_mejor_resultado") == [("ce", "900000001")]
