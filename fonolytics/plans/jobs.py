"""Registered jobs R1-R6 over the test tables, and their DuckDB oracle SQL.

Mapping (FIXTURES.md section 5): a call per ``events`` row, day = date of
``ts``, CJ call = ``event_type = 'error'``; client 360 over customer, orders
and lineitem; the load rules over ``orders``; phone re-scoring over the
contact fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.config import FIXTURE_CONFIG, ProfileConfig
from fonolytics.operators import callcenter as cc
from fonolytics.operators.alerts import assigned_phones_long
from fonolytics.operators.client360 import client_360, client_lookup, client_products
from fonolytics.operators.rescore import phone_rescore, phone_rescore_asof, phone_scores, scores_asof
from fonolytics.plans import oracle as o
from fonolytics.plans.materialize import scratch_path
from fonolytics.plans.month_bitmaps import assigned_clients, presence_from_bitmaps, read_bitmaps, refresh_bitmaps
from fonolytics.sources import fixtures as fx
from fonolytics.sources.fixtures import table
from fonolytics.sources.lookup_store import LookupStore, write_lookup_store
from fonolytics.sources.sinks import write_report
from fonolytics.sources.tables import string_partitions
from fonolytics.sources.validated_load import (
    ORDER_RULES,
    QUARANTINE,
    R_AMOUNT,
    R_AMOUNT_FINITE,
    R_AMOUNT_TEXT,
    R_CATEGORY,
    R_KEY_DUPLICATE,
    R_KEY_NULL,
    VALID,
    load_checked,
    load_summary,
    rule_counts,
    validate,
)

# Fixed value of the fixture mapping: which events play CJ calls.
CJ_EVENT_TYPE = "error"


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("ts", "event_type")
    return cc.daily_calls(ev, "ts", F.col("event_type") == CJ_EVENT_TYPE)


def q_transfer_savings(spark, sf_dir):
    return cc.transfer_savings(events_daily(spark, sf_dir))


def q_recovery_uplift(spark, sf_dir):
    return cc.recovery_uplift(events_daily(spark, sf_dir))


def q_saturday_recovery(spark, sf_dir):
    return cc.saturday_recovery(events_daily(spark, sf_dir))


def q_client_360(spark, sf_dir):
    return client_360(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def q_client_products(spark, sf_dir):
    return client_products(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


# A delivery with every kind of fault, as text: every line item is a delivered row, so orders of several
# lines come several times; some rows have no key, an amount that is no (finite) number, not positive or
# missing, or an unknown category.
FEED = """select case when l_suppkey % 10 <> 0 then l_orderkey end as o_orderkey,
       case when l_partkey % 11 = 0 then 'n/a' when l_partkey % 13 = 0 then '-1' when l_partkey % 17 = 0 then null
            when l_partkey % 19 = 0 then 'NaN' when l_partkey % 23 = 0 then '-Infinity' else '10.5' end as o_totalprice,
       case when l_suppkey % 7 = 0 then l_returnflag else '1-URGENT' end as o_orderpriority
from {lineitem}"""


def q_validated_load(spark, sf_dir):
    """The whole job: the tables are written to the shared folder, the accounting is what was observed meanwhile."""
    feed = spark.sql(FEED, lineitem=table(spark, sf_dir, "lineitem"))
    return load_checked(feed, scratch_path(spark, "load-target"), scratch_path(spark, "load-quarantine"), ORDER_RULES)


def q_validated_orders(spark, sf_dir):
    return load_summary(validate(table(spark, sf_dir, "orders"), ORDER_RULES))


def q_validated_load_rules(spark, sf_dir):
    return rule_counts(validate(spark.sql(FEED, lineitem=table(spark, sf_dir, "lineitem")), ORDER_RULES))


# The clients that the registered look-up asks for.
LOOKUP_SEGMENT = "BUILDING"


def q_client_lookup(spark, sf_dir):
    tables = [table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")]
    return client_lookup(*tables, F.col("c_mktsegment") == LOOKUP_SEGMENT)


def rescore_for(stages, cfg: ProfileConfig) -> DataFrame:
    window = stages.attempts_once.where(F.col("mes").between(cfg.period_lo, cfg.period_hi))
    slots = assigned_phones_long(stages.d10_clean_phones, cfg)
    return phone_rescore(slots, phone_scores(window), cfg)


def q_phone_rescore(spark, sf_dir):
    from fonolytics.plans.catalog import stages_for

    return rescore_for(stages_for(spark, sf_dir), FIXTURE_CONFIG)


def q_attempt_scores_asof(spark, sf_dir):
    """Every effective attempt with the score that its phone had when the call began."""
    from fonolytics.plans.catalog import stages_for

    calls = stages_for(spark, sf_dir).attempts_once.select("fuente", "mes", F.col("cu").alias("codunicocli"), "telefono", "fecha_key", "id_intento")
    return scores_asof(calls, fx.score_history(spark, sf_dir), "fecha_key", strict=True)


def q_phone_rescore_asof(spark, sf_dir):
    """Assigned phones in the order of the scores valid when the target month begins."""
    from fonolytics.plans.catalog import stages_for

    slots = assigned_phones_long(stages_for(spark, sf_dir).d10_clean_phones, FIXTURE_CONFIG)
    begin = F.to_timestamp(F.lit(fx.period_start(FIXTURE_CONFIG.target_period)))
    return phone_rescore_asof(slots.withColumn("fecha", begin), fx.score_history(spark, sf_dir), FIXTURE_CONFIG)


JOB_QUERIES = {
    "attempt_scores_asof": q_attempt_scores_asof,
    "phone_rescore_asof": q_phone_rescore_asof,
    "validated_orders": q_validated_orders,
    "validated_load_rules": q_validated_load_rules,
    "transfer_savings": q_transfer_savings,
    "recovery_uplift": q_recovery_uplift,
    "saturday_recovery": q_saturday_recovery,
    "client_360": q_client_360,
    "client_products": q_client_products,
    "client_360_lookup": q_client_lookup,
    "validated_load": q_validated_load,
    "phone_rescore": q_phone_rescore,
}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)

_DAILY = f"""daily as (
  select cast(ts as date) as dia, count(*) as llamadas,
         count(*) filter (where event_type = {o.q(CJ_EVENT_TYPE)}) as llamadas_cj
  from events group by 1
)"""


def _sql_transfer() -> str:
    arms = "\nunion all ".join(
        f"select dia, {o.q(sc.name)} as escenario, llamadas, llamadas_cj, {sc.minutes_per_call} as minutos_por_llamada, "
        f"cast(llamadas_cj * {sc.minutes_per_call} as double) as minutos_ahorrados from daily"
        for sc in cc.DEFAULT_SCENARIOS
    )
    return f"""with {_DAILY},
m as ({arms})
select dia, escenario, llamadas, llamadas_cj, cast(minutos_por_llamada as double) as minutos_por_llamada,
       minutos_ahorrados, minutos_ahorrados / cast(60 as double) as horas_dia,
       minutos_ahorrados / cast(60 as double) * cast({cc.WORKDAYS_PER_MONTH} as double) as horas_mes_habil,
       minutos_ahorrados / cast(60 as double) * cast({cc.CALENDAR_DAYS_PER_MONTH} as double) as horas_mes_calendario,
       minutos_ahorrados / cast(60 as double) / cast({cc.HOURS_PER_SHIFT} as double) as asesores_equivalentes
from m"""


def _sql_uplift() -> str:
    extra = f"llamadas_cj * ({cc.RESOLUTION_AFTER} - {cc.RESOLUTION_BEFORE})"
    return f"""with {_DAILY}
select dia, llamadas_cj, cast({extra} as double) as clientes_adicionales,
       cast({extra} * {cc.PAYMENT_RATE} * {cc.AVERAGE_PAYMENT} as double) as recuperado_dia
from daily"""


def _sql_saturday() -> str:
    lost = f"llamadas_cj * {cc.SATURDAY_LOST_RATE}"
    payers = f"round({lost} * {cc.SATURDAY_PAYER_RATE}, 0)"
    return f"""with {_DAILY}
select dia, llamadas_cj, cast({lost} as double) as contactos_perdidos,
       cast({payers} as bigint) as pagadores,
       cast({payers} * {cc.SATURDAY_AVERAGE_PAYMENT} as double) as recuperado_sabado,
       cast({payers} * {cc.SATURDAY_AVERAGE_PAYMENT} * {cc.SATURDAYS_PER_YEAR} as double) as recuperado_anual
from daily where isodow(dia) = 6"""


def _sql_client_360() -> str:
    def c(x):
        return f"cast(round({x} * 100.0) as bigint)"

    return f"""with li as (
  select l_orderkey, sum({c('l_extendedprice')}) as capital_c,
         sum({c('l_extendedprice * (1 - l_discount) * (1 + l_tax)')}) as cancelacion_c
  from lineitem group by 1
), pl as (
  select o.o_custkey as c_custkey, coalesce(li.capital_c, 0) as capital_c, {c('o.o_totalprice')} as deuda_c,
         coalesce(li.cancelacion_c, 0) as cancelacion_c
  from orders o left join li on o.o_orderkey = li.l_orderkey
), pc as (
  select c_custkey, count(*) as n_productos, sum(capital_c) as capital_c, sum(deuda_c) as deuda_c,
         sum(cancelacion_c) as cancelacion_c
  from pl group by 1
)
select c.c_custkey, c.c_name, c.c_mktsegment, coalesce(pc.n_productos, 0) as n_productos,
       cast(coalesce(pc.capital_c, 0) as double) / 100.0 as capital_total,
       cast(coalesce(pc.deuda_c, 0) as double) / 100.0 as deuda_total,
       cast(coalesce(pc.cancelacion_c, 0) as double) / 100.0 as importe_cancelacion
from customer c left join pc on c.c_custkey = pc.c_custkey"""


def _sql_client_products() -> str:
    def c(x):
        return f"cast(round({x} * 100.0) as bigint)"

    return f"""with li as (
  select l_orderkey, sum({c('l_extendedprice')}) as capital_c,
         sum({c('l_extendedprice * (1 - l_discount) * (1 + l_tax)')}) as cancelacion_c
  from lineitem group by 1
)
select o.o_custkey as c_custkey, o.o_orderkey as producto,
       cast(coalesce(li.capital_c, 0) as double) / 100.0 as capital,
       cast({c('o.o_totalprice')} as double) / 100.0 as deuda,
       cast(coalesce(li.cancelacion_c, 0) as double) / 100.0 as importe_cancelacion
from orders o left join li on o.o_orderkey = li.l_orderkey"""


def _checked_ctes(source: str) -> str:
    r = ORDER_RULES
    amount = f"try_cast(o.{r.amount} as double)"
    return f"""with feed as ({source}), dup as (
  select {r.key} from feed where {r.key} is not null group by 1 having count(*) > 1
), v as (
  select list_filter([
      case when o.{r.key} is null then {o.q(R_KEY_NULL)} end,
      case when d.{r.key} is not null then {o.q(R_KEY_DUPLICATE)} end,
      case when o.{r.amount} is not null and {amount} is null then {o.q(R_AMOUNT_TEXT)} end,
      case when not isfinite({amount}) then {o.q(R_AMOUNT_FINITE)} end,
      case when o.{r.amount} is null or ({amount} <= 0 and not isnan({amount})) then {o.q(R_AMOUNT)} end,
      case when o.{r.category} is null or o.{r.category} not in ({o.in_list(r.categories)}) then {o.q(R_CATEGORY)} end
    ], lambda x: x is not null) as motivos
  from feed o left join dup d on o.{r.key} = d.{r.key}
), por_motivo as (select unnest(motivos) as motivo, count(*) as filas from v group by 1)"""


def validated_load_sql(source: str) -> str:
    """Rows per status and first reason."""
    return f"""{_checked_ctes(source)}
select if(len(motivos) = 0, {o.q(VALID)}, {o.q(QUARANTINE)}) as estado, motivos[1] as motivo, count(*) as filas from v group by 1, 2"""


def validated_load_full_sql(source: str) -> str:
    return f"""{_checked_ctes(source)}
select {o.q(VALID)} as estado, null as motivo, count(*) as filas, cast(null as bigint) as filas_con_motivo from v where len(motivos) = 0 having count(*) > 0
union all
select {o.q(QUARANTINE)}, p.motivo, (select count(*) from v where motivos[1] = p.motivo), p.filas from por_motivo p"""


def _sql_score_history() -> str:
    return f"""select o.o_custkey as codunicocli,
       cast(900000000 + o.o_custkey * 100 + case when o.o_custkey % 10 = 0 then 1 else l.l_partkey % 13 + 1 end as varchar) as telefono,
       l.l_shipdate + interval {fx.SCORE_DAYS} day as vigente_desde, cast(l.l_quantity as bigint) as puntaje,
       l.l_orderkey * 10 + l.l_linenumber as id_puntaje
from lineitem l join orders o on o.o_orderkey = l.l_orderkey"""


# One row per phone and moment: the greatest id, by the rule for ties.
_SCORES = """select distinct on (codunicocli, telefono, vigente_desde) * from puntajes
order by codunicocli, telefono, vigente_desde, id_puntaje desc"""


def _sql_attempt_scores(cfg: ProfileConfig) -> str:
    extra = [("puntajes", _sql_score_history()), ("vigentes", _SCORES), ("llamadas", "from d2 union all from d3")]
    final = """select c.fuente, c.mes, c.cu as codunicocli, c.telefono, c.fecha_key, c.id_intento, s.puntaje, s.vigente_desde
from llamadas c asof left join vigentes s
  on c.cu = s.codunicocli and c.telefono = s.telefono and c.fecha_key > s.vigente_desde"""
    return o.with_chain(o.fixture_ctes(cfg) + o.stage_ctes(cfg) + extra, final)


def _sql_rescore_asof(cfg: ProfileConfig) -> str:
    n = cfg.n_phones
    begin = f"timestamp {o.q(fx.period_start(cfg.target_period))}"
    extra = [
        ("puntajes", _sql_score_history()),
        ("ultimo", f"""select codunicocli, telefono, arg_max(puntaje, (vigente_desde, id_puntaje)) as score
from puntajes where vigente_desde <= {begin} group by all"""),
        ("ranura", f"""select codunicocli, k as posicion, cast(numbers[k] as varchar) as telefono
from (select codunicocli, [{', '.join(f'telefono{k}' for k in range(1, n + 1))}] as numbers from d6), unnest(range(1, {n + 1})) as u(k)
where cast(numbers[k] as varchar) <> {o.q(o.EMPTY_PHONE)}"""),
        ("ordenado", """select codunicocli, posicion, coalesce(score, 0) as score, telefono,
       row_number() over (partition by codunicocli order by coalesce(score, 0) desc, posicion) as nueva
from ranura left join ultimo using (codunicocli, telefono)"""),
    ]
    final = f"""select codunicocli, {', '.join(f'max(telefono) filter (nueva = {k}) as telefono{k}' for k in range(1, n + 1))},
       cast(count(*) filter (nueva <> posicion) as bigint) as slots_cambiados, max(score) as mejor_score
from ordenado group by codunicocli"""
    return o.with_chain(o.fixture_ctes(cfg) + o.stage_ctes(cfg) + extra, final)


def _sql_phone_rescore(cfg: ProfileConfig, with_fixture: bool = True) -> str:
    n = cfg.n_phones
    slots = "\nunion all ".join(
        f"select codunicocli, {k} as posicion, cast(tlf{k}_limpio as varchar) as telefono from d10 where tlf{k}_limpio is not null"
        for k in range(1, n + 1)
    )
    cols = ",\n       ".join(f"max(case when nueva_posicion = {k} then telefono end) as telefono{k}" for k in range(1, n + 1))
    extra = [
        ("d10", f"select *, {o.clean_slots(cfg)} from d6"),
        ("effective_codes", f"""select conlusion_cloud from conclusiones
where tipo_resultado in ({o.in_list(cfg.outcome_types)})"""),
        ("calls", f"""select contact_id as cu, periodo as mes, right(dnis, {cfg.phone_digits}) as telefono
from intentos where campaign_name in ({o.in_list(cfg.campaigns)}) and wrap_up in (select * from effective_codes)
union all
select contact_id, periodo, right(dnis, {cfg.phone_digits}) from intentos_bkp
where campaign_name in ({o.in_list(cfg.campaigns)}) and wrap_up in (select * from effective_codes)
  and try_cast(periodo as integer) >= {cfg.backup_min_period}"""),
        ("scores", f"""select cu as codunicocli, telefono, count(*) as score
from calls
where cu is not null and mes between {o.q(cfg.period_lo)} and {o.q(cfg.period_hi)}
group by 1, 2"""),
        ("slots", slots),
        ("ranked", """select s.codunicocli, s.posicion, s.telefono, coalesce(sc.score, 0) as score,
       row_number() over (partition by s.codunicocli order by coalesce(sc.score, 0) desc, s.posicion asc) as nueva_posicion
from slots s left join scores sc on sc.codunicocli = s.codunicocli and sc.telefono = s.telefono"""),
    ]
    final = f"""select codunicocli,
       {cols},
       cast(sum(case when nueva_posicion <> posicion then 1 else 0 end) as bigint) as slots_cambiados,
       max(score) as mejor_score
from ranked group by codunicocli"""
    head = o.fixture_ctes(cfg) if with_fixture else []
    return o.with_chain(head + o.stage_ctes(cfg) + extra, final)


def job_sql(cfg: ProfileConfig = FIXTURE_CONFIG) -> dict[str, str]:
    return {
        "transfer_savings": _sql_transfer(),
        "recovery_uplift": _sql_uplift(),
        "saturday_recovery": _sql_saturday(),
        "client_360": _sql_client_360(),
        "client_products": _sql_client_products(),
        "client_360_by_identifier": f"""select i.tipo, i.valor, c.* from ({_sql_client_360()}) c join (
  select c_custkey, 'CU' as tipo, cast(c_custkey as varchar) as valor from customer
  union all select c_custkey, 'DOC', lpad(cast(c_custkey * 7919 + 10000019 as varchar), 12, '0') from customer
  union all select c_custkey, 'CJ', 'J' || c_nationkey from customer where c_mktsegment = {o.q(fx.CJ_SEGMENT)}
) i using (c_custkey)""",
        "client_360_lookup": f"select * from ({_sql_client_360()}) where c_mktsegment = {o.q(LOOKUP_SEGMENT)}",
        "validated_load": validated_load_full_sql(FEED.format(lineitem="lineitem")),
        "validated_load_rules": f"{_checked_ctes(FEED.format(lineitem='lineitem'))} select motivo, filas from por_motivo",
        "validated_orders": validated_load_sql("from orders"),
        "attempt_scores_asof": _sql_attempt_scores(cfg),
        "phone_rescore_asof": _sql_rescore_asof(cfg),
        "phone_rescore": _sql_phone_rescore(cfg),
        # the streaming job must agree with the batch first contacts
        "first_contact_stream": o.stage_sql(cfg)["first_contact_per_period"],
        "presence_from_bitmaps": o.stage_sql(cfg)["presence_matrix"],
        "assigned_clients": o.with_chain(o.fixture_ctes(cfg), f"""
select p.codmes, count(distinct codunicocli) filter (a.codmes = p.codmes) as clientes, count(distinct codunicocli) as clientes_acumulados
from (select unnest([{o.in_list(cfg.periods)}]) as codmes) p
join (from asignacion where list_contains([{o.in_list(cfg.stages)}], tramo_asignacion) and list_contains([{o.in_list(cfg.periods)}], codmes)) a on a.codmes <= p.codmes
group by all"""),
        "alert_summary_report": f"select *, {o.q(cfg.target_period)} as periodo_objetivo from ({o.stage_sql(cfg)['alert_summary']})",
        "first_contact_state_stream": o.stage_sql(cfg)["first_contact_per_period"],
    }


def q_first_contact_stream(spark, sf_dir):
    """D5 computed by the streaming job (file stream of line items)."""
    from fonolytics.streaming.first_contact import run_fixture_stream

    return run_fixture_stream(spark, sf_dir, FIXTURE_CONFIG)


def q_client_by_identifier(spark, sf_dir):
    """The stored client 360 asked for every identifier that there is."""
    path, ids = scratch_path(spark, "lookup"), fx.client_identifiers(spark, sf_dir)
    write_lookup_store(ids, q_client_360(spark, sf_dir), q_client_products(spark, sf_dir), path, "c_custkey")
    return LookupStore(spark, path, "c_custkey").clients(ids.select("tipo", "valor").distinct())


def _stored_bitmaps(spark, sf_dir):
    """Month bitmaps as two runs leave them: all months but the target one, then that one."""
    asignacion, store = fx.assignment_history(spark, sf_dir), scratch_path(spark, "bitmaps")
    refresh_bitmaps(asignacion, FIXTURE_CONFIG, store, FIXTURE_CONFIG.periods[:-1])
    refresh_bitmaps(asignacion, FIXTURE_CONFIG, store, FIXTURE_CONFIG.periods)
    return read_bitmaps(spark, FIXTURE_CONFIG, store)


def q_presence_from_bitmaps(spark, sf_dir):
    return presence_from_bitmaps(_stored_bitmaps(spark, sf_dir), FIXTURE_CONFIG)


def q_assigned_clients(spark, sf_dir):
    return assigned_clients(_stored_bitmaps(spark, sf_dir), FIXTURE_CONFIG.periods)


def q_alert_summary_report(spark, sf_dir):
    """Query 3 as a reader gets it: an earlier report of the month is replaced by the new one, which is read back."""
    from fonolytics.plans.catalog import stages_for

    path = scratch_path(spark, "report")
    summary = stages_for(spark, sf_dir).d18_summary(ordered=False)
    write_report(summary.where(F.col("ranking_gravedad") == 1), path, FIXTURE_CONFIG)
    write_report(summary, path, FIXTURE_CONFIG)
    with string_partitions(spark):
        return spark.read.parquet(path)


def q_first_contact_state_stream(spark, sf_dir):
    """D5 from the keyed-state stream, with the outcome catalogue applied when it is read."""
    from fonolytics.streaming.contact_state import run_fixture_state_stream

    return run_fixture_state_stream(spark, sf_dir, FIXTURE_CONFIG)


JOB_QUERIES["first_contact_stream"] = q_first_contact_stream
JOB_QUERIES["client_360_by_identifier"] = q_client_by_identifier
JOB_QUERIES["presence_from_bitmaps"] = q_presence_from_bitmaps
JOB_QUERIES["assigned_clients"] = q_assigned_clients
JOB_QUERIES["alert_summary_report"] = q_alert_summary_report
JOB_QUERIES["first_contact_state_stream"] = q_first_contact_state_stream
