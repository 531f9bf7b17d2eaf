"""Daily call-centre impact figures: time saved, recovery uplift, Saturday recovery.

The business case states only formulas with example rates; here the call
volumes come from a call log aggregated per day, and every rate is a
parameter. Products of counts and rates use exact decimals (0.70 - 0.40 is
0.30, not 0.29999999999999993); divisions then run in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransferScenario:
    name: str
    minutes_per_call: Decimal


# The worked example of the business case.
# Scenario 1: a transfer takes 1.5 minutes; scenario 2 adds a 0.5-minute
# second validation (2 minutes per call).
DEFAULT_SCENARIOS = (
    TransferScenario("transferencia", Decimal("1.5")),
    TransferScenario("transferencia_y_validacion", Decimal("2.0")),
)
WORKDAYS_PER_MONTH = 22
CALENDAR_DAYS_PER_MONTH = 30
HOURS_PER_SHIFT = 8
RESOLUTION_BEFORE = Decimal("0.40")
RESOLUTION_AFTER = Decimal("0.70")
PAYMENT_RATE = Decimal("0.15")
AVERAGE_PAYMENT = Decimal("300")
SATURDAY_LOST_RATE = Decimal("0.20")
# 15 of the 112 lost Saturday contacts pay (rounded to whole clients).
SATURDAY_PAYER_RATE = Decimal("0.134")
SATURDAY_AVERAGE_PAYMENT = Decimal("500")
SATURDAYS_PER_YEAR = 52


def dec(x: Decimal) -> Column:
    return F.lit(x)


def daily_calls(calls: DataFrame, ts_col: str, is_cj: Column) -> DataFrame:
    """Calls and CJ calls per day. One partial aggregate: a day is a group,
    and map-side combining keeps a busy day from reaching one task whole."""
    return calls.groupBy(F.to_date(F.col(ts_col)).alias("dia")).agg(
        F.count(F.lit(1)).alias("llamadas"),
        F.count_if(is_cj).alias("llamadas_cj"),
    )


def transfer_savings(daily: DataFrame, scenarios=DEFAULT_SCENARIOS) -> DataFrame:
    """Minutes and hours saved per day and scenario, per month, in advisers.

    The scenarios are a handful of literals, generated per day with
    ``inline`` (no join).
    """
    sc = F.array(*[F.struct(F.lit(s.name).alias("escenario"), dec(s.minutes_per_call).alias("minutos_por_llamada"))
                   for s in scenarios])
    minutes = (F.col("llamadas_cj") * F.col("minutos_por_llamada")).cast("double")
    hours = F.col("minutos_ahorrados") / F.lit(60.0)
    return (
        daily.select("dia", "llamadas", "llamadas_cj", F.inline(sc))
        .withColumn("minutos_ahorrados", minutes)
        .withColumn("horas_dia", hours)
        .select(
            "dia", "escenario", "llamadas", "llamadas_cj",
            F.col("minutos_por_llamada").cast("double").alias("minutos_por_llamada"),
            "minutos_ahorrados", "horas_dia",
            (F.col("horas_dia") * F.lit(float(WORKDAYS_PER_MONTH))).alias("horas_mes_habil"),
            (F.col("horas_dia") * F.lit(float(CALENDAR_DAYS_PER_MONTH))).alias("horas_mes_calendario"),
            (F.col("horas_dia") / F.lit(float(HOURS_PER_SHIFT))).alias("asesores_equivalentes"),
        )
    )


def recovery_uplift(
    daily: DataFrame,
    before: Decimal = RESOLUTION_BEFORE,
    after: Decimal = RESOLUTION_AFTER,
    pay_rate: Decimal = PAYMENT_RATE,
    avg_payment: Decimal = AVERAGE_PAYMENT,
) -> DataFrame:
    """R2: extra clients solved per day and the money they bring back."""
    extra = F.col("llamadas_cj") * (dec(after) - dec(before))
    return daily.select(
        "dia",
        "llamadas_cj",
        extra.cast("double").alias("clientes_adicionales"),
        (extra * dec(pay_rate) * dec(avg_payment)).cast("double").alias("recuperado_dia"),
    )


def saturday_recovery(
    daily: DataFrame,
    lost_rate: Decimal = SATURDAY_LOST_RATE,
    payer_rate: Decimal = SATURDAY_PAYER_RATE,
    avg_payment: Decimal = SATURDAY_AVERAGE_PAYMENT,
    saturdays: int = SATURDAYS_PER_YEAR,
) -> DataFrame:
    """On Saturdays, contacts lost without the screen and what paying them back is worth."""
    lost = F.col("llamadas_cj") * dec(lost_rate)
    payers = F.round(lost * dec(payer_rate), 0)
    recovered = payers * dec(avg_payment)
    return daily.where(F.dayofweek("dia") == 7).select(
        "dia",
        "llamadas_cj",
        lost.cast("double").alias("contactos_perdidos"),
        payers.cast("bigint").alias("pagadores"),
        recovered.cast("double").alias("recuperado_sabado"),
        (recovered * F.lit(saturdays)).cast("double").alias("recuperado_anual"),
    )
