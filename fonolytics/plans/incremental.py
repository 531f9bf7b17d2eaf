"""Monthly runs that read each month of attempts once, not once per run.

Every run of the profile covers an eight-month window, so recomputing the
first contacts of all eight months re-reads seven months of attempts that
have not changed. First contacts are separable by month (they are grouped by
client and month), so completed months are kept in a store partitioned by
``mes``; a run computes only the months missing from the store plus the ones
asked for again (by default the target month, whose calls may still be
arriving). The attempt scans are filtered to those months, which prunes the
other month partitions at the source.

The month cells and the target contact use only the configured periods, so
reading the store for exactly those periods gives the same profile as
computing from all attempts (tested).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.config import ProfileConfig
from fonolytics.operators.attempts import first_contacts
from fonolytics.plans.materialize import folder
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.tables import string_partitions

STORE_COLUMNS = ["fuente", "cu", "wrap_up", "telefono", "orden", "mes"]
STORE_SCHEMA = "fuente string, cu bigint, wrap_up string, telefono string, orden bigint, mes string"


def catalogue_mark(codes: DataFrame) -> list[str]:
    """What tells two sets of effective codes apart: their number and two order-free sums of hashes."""
    h, g = F.xxhash64("conclusion"), F.xxhash64(F.lit(1), "conclusion")
    found = codes.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(g.cast("decimal(38,0)")).alias("s")).first()
    return [str(v) for v in found]


def settings_folder(store: str, cfg: ProfileConfig, codes: DataFrame) -> str:
    """The part of the store for the settings and the effective codes that first contacts depend on; others have another."""
    settings = [cfg.campaigns, cfg.outcome_types, cfg.phone_digits, cfg.backup_min_period, cfg.normalise_text, cfg.dedup, catalogue_mark(codes)]
    return f"{store.rstrip('/')}/ajustes={hashlib.sha256(json.dumps(settings).encode()).hexdigest()[:16]}"


# A file per complete month, below the settings folder (names with an underscore are no data to Spark).
_DONE = "_completos"


def stored_months(spark: SparkSession, part: str) -> set[str]:
    """Complete months of a settings folder, also those without any contact. Only a missing folder means none."""
    fs, path = folder(spark, f"{part}/{_DONE}")
    if not fs.exists(path):
        return set()
    return {f.getPath().getName() for f in fs.listStatus(path)}


def refresh_store(stages: ContactStages, store: str, recompute: Iterable[str] | None = None) -> list[str]:
    """Compute and write the window's months that are missing or to be redone; return them.

    A month is complete once its mark is there. The mark goes first and comes
    back last, and the month's old rows are removed before new ones are
    written: a run that breaks off at any step, also while Spark moves the
    written files, leaves the month incomplete, and the next run does it again.
    """
    cfg = stages.cfg
    spark = stages.tables.intentos.sparkSession
    part = settings_folder(store, cfg, stages.effective_codes)
    redo = set(recompute) if recompute is not None else {cfg.target_period}
    months = sorted((set(cfg.periods) - stored_months(spark, part)) | (redo & set(cfg.periods)))
    if months:
        for name in [f"{_DONE}/{m}" for m in months] + [f"mes={m}" for m in months]:
            fs, path = folder(spark, f"{part}/{name}")
            fs.delete(path, True)
        fresh = first_contacts(stages.attempts_once.where(F.col("mes").isin(months)), by_source=not cfg.dedup)
        fresh.select(*STORE_COLUMNS).write.mode("append").partitionBy("mes").parquet(part)
        mark_complete(spark, part, months)
    return months


def mark_complete(spark: SparkSession, part: str, months: Iterable[str]) -> None:
    for m in months:
        fs, path = folder(spark, f"{part}/{_DONE}/{m}")
        fs.create(path, True).close()


def read_store(spark: SparkSession, part: str, periods: Iterable[str]) -> DataFrame:
    """First contacts of the given months in a settings folder, in the D5 layout."""
    with string_partitions(spark):
        # a store without any contact has no files to tell the columns from
        df = spark.read.schema(STORE_SCHEMA).parquet(part)
    return df.where(F.col("mes").isin(list(periods))).select("fuente", "mes", "cu", "wrap_up", "telefono", "orden")


def with_first_contact_store(
    stages: ContactStages, store: str, recompute: Iterable[str] | None = None
) -> ContactStages:
    """The same stages, with D5 read from the refreshed month store.

    Runs with other campaigns, outcome types, phone digits, backup bound, text
    normalisation, ``dedup`` or other effective codes in the catalogue use
    another part of the store.
    """
    refresh_store(stages, store, recompute)
    spark = stages.tables.intentos.sparkSession
    return ContactStages(
        stages.tables, stages.cfg, base=stages.base_mode,
        first_contacts=read_store(spark, settings_folder(store, stages.cfg, stages.effective_codes), stages.cfg.periods),
    )
