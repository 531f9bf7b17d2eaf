"""Small hand-written contact tables for edge cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from fonolytics.config import ProfileConfig
from fonolytics.sources.tables import ATTEMPT_SCHEMA, OUTCOME_SCHEMA, ContactTables, assignment_schema

CFG = ProfileConfig(periods=("202601", "202602", "202603"), labels=("enero", "febrero", "marzo"),
                    backup_min_period=202601, n_phones=3)

OUTCOMES = [("CE", "contacto - efectivo"), ("PDP", "pdp"), ("NC", "no contacto")]


def ts(day: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2026, 1, day, 10, minute)


def attempt(periodo, cu, wrap, dnis, when, idx=1, campaign="cob_bpe_00"):
    return (periodo, cu, wrap, dnis, when, idx, campaign)


def assign(cu, codmes, phones, tramo="temprana", ida=1, saldo=1.0):
    return (cu, codmes, tramo, ida, saldo, *phones)


def tables(spark, live=(), bkp=(), outcomes=OUTCOMES, asig=(), phone_type=T.LongType(), n_phones=3):
    return ContactTables(
        intentos=spark.createDataFrame(list(live), ATTEMPT_SCHEMA),
        intentos_bkp=spark.createDataFrame(list(bkp), ATTEMPT_SCHEMA),
        conclusiones=spark.createDataFrame(list(outcomes), OUTCOME_SCHEMA),
        asignacion=spark.createDataFrame(list(asig), assignment_schema(n_phones, phone_type)),
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
