"""Registered queries: one per stage of SURVEY 2.2 (and the jobs of 2.3).

Each entry takes ``(spark, sf_dir)``, reads the supplied test tables through
the fixture views and returns the stage's ``DataFrame``. ``oracle_sql``
returns DuckDB SQL with the same column names for the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fonolytics.config import FIXTURE_CONFIG, ProfileConfig
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.fixtures import fixture_tables

QueryFn = Callable[[SparkSession, str], DataFrame]


def stages_for(spark: SparkSession, sf_dir: str, cfg: ProfileConfig = FIXTURE_CONFIG, base: str = "none") -> ContactStages:
    return ContactStages(fixture_tables(spark, sf_dir, cfg), cfg, base=base)


def _stage(getter: Callable[[ContactStages], DataFrame], cfg: ProfileConfig = FIXTURE_CONFIG) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getter(stages_for(spark, sf_dir, cfg))

    return run


ATTEMPT_COLS = ["mes", "cu", "wrap_up", "telefono"]
RANKED_COLS = ["fuente", "mes", "cu", "wrap_up", "telefono", "orden"]


def contact_queries(cfg: ProfileConfig = FIXTURE_CONFIG) -> dict[str, QueryFn]:
    return {
        "effective_outcomes": _stage(lambda p: p.d1_effective_outcomes, cfg),
        "effective_attempts_live": _stage(lambda p: p.d2_live.select(*ATTEMPT_COLS), cfg),
        "effective_attempts_backup": _stage(lambda p: p.d3_backup.select(*ATTEMPT_COLS), cfg),
        "effective_attempts": _stage(lambda p: p.d4_effective_attempts.select(*RANKED_COLS), cfg),
        "first_contact_per_period": _stage(lambda p: p.d5_first_contacts, cfg),
        "assignment_snapshot": _stage(lambda p: p.d6_snapshot, cfg),
        "presence_matrix": _stage(lambda p: p.d7_presence, cfg),
        "contact_matrix": _stage(lambda p: p.d8_contacts, cfg),
        "target_period_contact": _stage(lambda p: p.d9_target_contact, cfg),
        "clean_phones": _stage(lambda p: p.d10_clean_phones, cfg),
        "month_status": _stage(lambda p: p.d11_month_status, cfg),
        "client_profile": _stage(lambda p: p.d12_profile, cfg),
        "contact_phones_long": _stage(lambda p: p.d13_contact_phones, cfg),
        "assigned_phones_long": _stage(lambda p: p.d14_assigned_phones, cfg),
        "alerts_priority": _stage(lambda p: p.d15_priority, cfg),
        "alerts_dead_phones": _stage(lambda p: p.d16_dead, cfg),
        "phone_alerts": _stage(lambda p: p.d17_alerts(), cfg),
        "alert_summary": _stage(lambda p: p.d18_summary(), cfg),
        "a1_positions": _stage(lambda p: p.d19_a1, cfg),
        "a2_clients": _stage(lambda p: p.d20_a2, cfg),
        "a3_positions": _stage(lambda p: p.d21_a3, cfg),
        "client_profile_alerts": _stage(lambda p: p.d22_profile_alerts, cfg),
    }


def all_queries() -> dict[str, QueryFn]:
    from fonolytics.plans.jobs import JOB_QUERIES

    return {**contact_queries(), **JOB_QUERIES}


def all_oracle_sql() -> dict[str, str]:
    from fonolytics.plans.jobs import job_sql
    from fonolytics.plans.oracle import stage_sql

    return {**stage_sql(FIXTURE_CONFIG), **job_sql(FIXTURE_CONFIG)}
