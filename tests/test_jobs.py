"""The worked numbers of the business case and the load/rescore rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fonolytics.operators import callcenter as cc
from fonolytics.operators.client360 import client_360
from fonolytics.operators.rescore import phone_rescore, phone_rescore_asof, phone_scores
from fonolytics.sources.validated_load import ORDER_RULES, load_checked, load_summary, validate, validated_load
from helpers import CFG


@pytest.fixture(scope="module")
def saturday(spark):
    # 3,048 inbound calls on one Saturday, 560 of them CJ
    day = dt.datetime(2024, 1, 6, 9, 0)
    calls = spark.range(3048).select(
        (F.lit(day) + F.make_interval(secs=F.col("id").cast("int"))).alias("ts"),
        (F.col("id") < 560).alias("cj"),
    )
    return cc.daily_calls(calls, "ts", F.col("cj"))


def test_transfer_savings_worked_example(saturday):
    r = {x.escenario: x for x in cc.transfer_savings(saturday).collect()}
    t = r["transferencia"]
    assert (t.llamadas, t.llamadas_cj, t.minutos_ahorrados, t.horas_dia) == (3048, 560, 840.0, 14.0)
    assert (t.horas_mes_habil, t.horas_mes_calendario, t.asesores_equivalentes) == (308.0, 420.0, 1.75)
    v = r["transferencia_y_validacion"]
    assert v.minutos_ahorrados == 1120.0
    assert round(v.horas_dia, 2) == 18.67 and round(v.horas_mes_calendario) == 560


def test_recovery_uplift_worked_example(saturday):
    r = cc.recovery_uplift(saturday).first()
    assert (r.clientes_adicionales, r.recuperado_dia) == (168.0, 7560.0)


def test_saturday_recovery_worked_example(saturday):
    r = cc.saturday_recovery(saturday).first()
    assert (r.contactos_perdidos, r.pagadores, r.recuperado_sabado, r.recuperado_anual) == (112.0, 15, 7500.0, 390000.0)


def test_saturday_only(spark):
    calls = spark.createDataFrame([(dt.datetime(2024, 1, 5, 10),), (dt.datetime(2024, 1, 6, 10),)], "ts timestamp")
    daily = cc.daily_calls(calls, "ts", F.lit(True))
    assert [r.dia for r in cc.saturday_recovery(daily).collect()] == [dt.date(2024, 1, 6)]


def test_client_360_sums_in_cents(spark):
    cust = spark.createDataFrame([(1, "a", "X"), (2, "b", "Y")], "c_custkey long, c_name string, c_mktsegment string")
    orders = spark.createDataFrame([(10, 1, 100.10), (11, 1, 0.20)], "o_orderkey long, o_custkey long, o_totalprice double")
    li = spark.createDataFrame([(10, 0.1, 0.0, 0.0), (10, 0.2, 0.0, 0.0), (11, 5.0, 0.5, 0.1)],
                               "l_orderkey long, l_extendedprice double, l_discount double, l_tax double")
    got = {r.c_custkey: r for r in client_360(cust, orders, li).collect()}
    assert (got[1].n_productos, got[1].capital_total, got[1].deuda_total, got[1].importe_cancelacion) == (2, 5.3, 100.3, 3.05)
    assert (got[2].n_productos, got[2].capital_total) == (0, 0.0)


def test_validation_rules(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "1-URGENT"), (2, 10.0, "1-URGENT"), (2, 5.0, "2-HIGH"), (None, 1.0, "1-URGENT"),
         (3, 0.0, "1-URGENT"), (4, 1.0, "9-X"), (5, None, "5-LOW")],
        "o_orderkey long, o_totalprice double, o_orderpriority string")
    got = {(r.estado, r.motivo): r.filas for r in load_summary(validate(df, ORDER_RULES)).collect()}
    assert got == {("valido", None): 1, ("cuarentena", "clave_duplicada"): 2, ("cuarentena", "clave_nula"): 1,
                   ("cuarentena", "monto_no_positivo"): 2, ("cuarentena", "categoria_desconocida"): 1}


def test_validated_load_writes_target_and_quarantine(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text("o_orderkey,o_totalprice,o_orderpriority\n1,5.0,1-URGENT\n1,6.0,2-HIGH\n2,7.0,3-MEDIUM\n")
    summary = validated_load(spark, str(src), str(tmp_path / "t"), str(tmp_path / "q"), ORDER_RULES,
                             schema="o_orderkey long, o_totalprice double, o_orderpriority string")
    got = {(r.estado, r.motivo): r.filas for r in summary.collect()}
    assert got == {("valido", None): 1, ("cuarentena", "clave_duplicada"): 2}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_validated_load_of_text_keeps_what_stood_in_the_file(spark, tmp_path):
    from fonolytics.plans.materialize import scratch_count

    src, t, q = tmp_path / "in.csv", str(tmp_path / "t"), str(tmp_path / "q")
    src.write_text("o_orderkey,o_totalprice,o_orderpriority\n1,10.5,1-URGENT\n2,abc,2-HIGH\n,7.0,3-MEDIUM\n,8.0,3-MEDIUM\n5,-1,5-LOW\n")
    before = scratch_count()
    summary = validated_load(spark, str(src), t, q, ORDER_RULES, schema="o_orderkey long, o_totalprice double, o_orderpriority string")
    got = {(r.estado, r.motivo): r.filas for r in summary.collect()}
    assert got == {("valido", None): 1, ("cuarentena", "monto_no_numerico"): 1, ("cuarentena", "clave_nula"): 2, ("cuarentena", "monto_no_positivo"): 1}
    assert [tuple(r) for r in spark.read.parquet(t).collect()] == [(1, 10.5, "1-URGENT")]
    assert spark.read.parquet(q).where("motivo = 'monto_no_numerico'").first().o_totalprice == "abc"
    assert scratch_count() == before


def test_registered_load_has_every_reason(spark):
    from conftest import SF001
    from fonolytics.plans.jobs import q_validated_load

    got = {r.motivo for r in q_validated_load(spark, SF001).collect()}
    assert got == {None, "clave_nula", "clave_duplicada", "monto_no_numerico", "monto_no_finito", "monto_no_positivo", "categoria_desconocida"}


def test_load_accounting_equals_the_tables(spark, tmp_path):
    """Observed while writing: first reasons add up to the rows, and every broken rule of a row is counted."""
    t, q = str(tmp_path / "t"), str(tmp_path / "q")
    feed = spark.createDataFrame(
        [("1", "1.5", "1-URGENT"), (None, "NaN", "x"), ("2", "1e400", "1-URGENT"), ("3", "-Infinity", "5-LOW"), ("4", "abc", None),
         ("5", None, "5-LOW"), ("6", "2", "5-LOW"), ("6", "-2", "nope")],
        "o_orderkey string, o_totalprice string, o_orderpriority string")
    got = {r.motivo: (r.filas, r.filas_con_motivo) for r in load_checked(feed, t, q, ORDER_RULES).collect()}
    assert got == {None: (1, None), "clave_nula": (1, 1), "clave_duplicada": (2, 2), "monto_no_numerico": (1, 1),
                   "monto_no_finito": (2, 3), "monto_no_positivo": (1, 3), "categoria_desconocida": (0, 3)}
    rejects = spark.read.parquet(q)
    assert spark.read.parquet(t).count() == got[None][0] and rejects.count() == sum(n for m, (n, _) in got.items() if m)
    by_rule = {r.motivo: r["count"] for r in rejects.select(F.explode("motivos").alias("motivo")).groupBy("motivo").count().collect()}
    assert by_rule == {m: n for m, (_, n) in got.items() if m}
    assert load_checked(feed.limit(0), t, q, ORDER_RULES).collect() == []
    assert spark.read.parquet(t).count() == spark.read.parquet(q).count() == 0


def test_scores_valid_at_a_time_order_the_slots(spark):
    slots = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 50), (1, 3, "c", 50), (2, 1, "a", 5)],
                                  "codunicocli long, posicion int, telefono string, s long").withColumn("fecha", F.timestamp_seconds("s")).drop("s")
    history = spark.createDataFrame(
        [(1, "a", 10, 9, 1), (1, "a", 40, 2, 2), (1, "a", 60, 99, 3),  # the newest by then is 2
         (1, "b", 50, 7, 4), (1, "b", 50, 8, 5),                       # from that moment on; the greater id counts
         (2, "a", 6, 5, 6)],                                           # too late
        "codunicocli long, telefono string, u long, puntaje long, id_puntaje long").withColumn("vigente_desde", F.timestamp_seconds("u"))
    got = {r.codunicocli: r for r in phone_rescore_asof(slots, history, CFG).collect()}
    assert (got[1].telefono1, got[1].telefono2, got[1].telefono3, got[1].mejor_score) == ("b", "a", "c", 8)
    assert (got[2].telefono1, got[2].mejor_score, got[2].slots_cambiados) == ("a", 0, 0)


def test_lookup_restricts_the_lines_first(spark):
    from conftest import SF001
    from fonolytics.plans.jobs import q_client_lookup

    plan = q_client_lookup(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan.index("Aggregate [l_orderkey")
    assert "LeftSemi" in plan[aggregate:] and plan[aggregate:].index("LeftSemi") < plan[aggregate:].index("l_extendedprice", 400)


def test_phone_rescore_orders_by_score_then_slot(spark):
    slots = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "codunicocli long, posicion int, telefono string")
    eff = spark.createDataFrame([(1, "c"), (1, "c"), (1, "b")], "cu long, telefono string")
    r = phone_rescore(slots, phone_scores(eff), CFG).first()
    assert (r.telefono1, r.telefono2, r.telefono3, r.slots_cambiados, r.mejor_score) == ("c", "b", "a", 2, 2)


def test_client_products_and_lookup(spark):
    from fonolytics.operators.client360 import client_products, lookup

    orders = spark.createDataFrame([(10, 1, 100.10), (11, 1, 0.20), (12, 2, 3.0)], "o_orderkey long, o_custkey long, o_totalprice double")
    li = spark.createDataFrame([(10, 0.1, 0.0, 0.0), (10, 0.2, 0.0, 0.0)],
                               "l_orderkey long, l_extendedprice double, l_discount double, l_tax double")
    got = sorted((r.producto, r.capital, r.deuda) for r in lookup(client_products(orders, li), c_custkey=1).collect())
    assert got == [(10, 0.3, 100.1), (11, 0.0, 0.2)]


def test_phone_scores_count_each_call_once(spark):
    from fonolytics.plans.jobs import rescore_for
    from fonolytics.plans.stages import ContactStages
    from helpers import CFG as HCFG
    from helpers import assign, attempt, tables, ts

    live = [attempt("202603", 1, "CE", "51900000002", ts(1)), attempt("202603", 1, "CE", "51900000002", ts(2), 2)]
    asig = [assign(1, "202603", (900000001, 900000002, 0))]
    once = rescore_for(ContactStages(tables(spark, live=live, asig=asig), HCFG), HCFG).first()
    twice_t = tables(spark, live=live, asig=asig,
                     outcomes=[("CE", "contacto - efectivo"), ("CE", "contacto - efectivo")])
    twice = rescore_for(ContactStages(twice_t, HCFG), HCFG).first()
    assert once.mejor_score == twice.mejor_score == 2
    assert (twice.telefono1, twice.telefono2) == ("900000002", "900000001")
