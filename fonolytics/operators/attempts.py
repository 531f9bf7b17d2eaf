"""Effective attempts and first contact per client and month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.config import SOURCE_BACKUP, SOURCE_LIVE, ProfileConfig
from fonolytics.functions.phones import first_row, last_digits
from fonolytics.operators.sorted_scan import row_number_by_range
from fonolytics.plans.materialize import materialize_shared
from fonolytics.sources.tables import ContactTables

# Columns that make the order of attempts total (S4): time first, then our
# attempt id, the dialled number and the outcome code.
ATTEMPT_ORDER = ("fecha_key", "id_intento", "dnis", "wrap_up")


def effective_outcomes(conclusiones: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Outcome codes whose type counts as an effective contact."""
    return conclusiones.where(F.col("tipo_resultado").isin(list(cfg.outcome_types))).select(
        F.col("conlusion_cloud").alias("conclusion")
    )


def effective_codes(conclusiones: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """(conclusion, copies): the effective codes with how often the catalogue lists them.

    Written to the shared folder and read back, so Spark plans the joins with
    its true size: a small catalogue is broadcast, a large one shuffled. One
    written copy serves all plans over the same, unchanged catalogue files.
    """
    effective = effective_outcomes(conclusiones, cfg).where(F.col("conclusion").isNotNull())
    return materialize_shared(effective.groupBy("conclusion").agg(F.count(F.lit(1)).cast("int").alias("copies")))


def outcome_filter(
    conclusiones: DataFrame, cfg: ProfileConfig, replicate: bool = True, codes: DataFrame | None = None
) -> Callable[[DataFrame], DataFrame]:
    """How attempts are restricted to effective outcomes: a join with ``effective_codes``.

    The scripts inner-join attempts to the outcome catalogue, so an attempt
    appears once per catalogue row of its code: normally once, k times for a
    code listed k times (S3). ``replicate`` keeps those copies (the attempt
    lists); without it each attempt appears once (first contacts, where the
    copies vanish anyway, and call counts).
    """
    found = codes if codes is not None else effective_codes(conclusiones, cfg)

    def keep(df: DataFrame) -> DataFrame:
        match = df["wrap_up"] == found["conclusion"]
        if not replicate:
            return df.join(found, match, "left_semi")
        copied = df.join(found, match).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        return copied.drop("_copy", "copies", "conclusion")

    return keep


def _arm(
    intentos: DataFrame,
    keep_effective: Callable[[DataFrame], DataFrame],
    cfg: ProfileConfig,
    source: str,
    min_period: int | None,
) -> DataFrame:
    df = intentos.where(F.col("campaign_name").isin(list(cfg.campaigns)))
    if min_period is not None:
        # A period that is not a number drops out instead of failing.
        df = df.where(F.col("periodo").try_cast("int") >= F.lit(min_period))
    return _attempt_columns(keep_effective(df), F.lit(source), cfg)


def _attempt_columns(df: DataFrame, source: Column, cfg: ProfileConfig) -> DataFrame:
    return df.select(
        source.alias("fuente"),
        F.col("periodo").alias("mes"),
        F.col("contact_id").alias("cu"),
        "wrap_up",
        last_digits("dnis", cfg.phone_digits).alias("telefono"),
        "fecha_key",
        # the source tables have no attempt id: the other columns of the order then decide
        (F.col("id_intento") if "id_intento" in df.columns else F.lit(None).cast("bigint")).alias("id_intento"),
        "dnis",
    )


def effective_attempts_live(
    tables: ContactTables, cfg: ProfileConfig, keep_effective: Callable | None = None
) -> DataFrame:
    """Live attempts of the campaigns with an effective outcome; no period bound."""
    keep = keep_effective or outcome_filter(tables.conclusiones, cfg)
    return _arm(tables.intentos, keep, cfg, SOURCE_LIVE, None)


def effective_attempts_backup(
    tables: ContactTables, cfg: ProfileConfig, keep_effective: Callable | None = None
) -> DataFrame:
    """D3: the same on the backup table, from ``backup_min_period`` on."""
    keep = keep_effective or outcome_filter(tables.conclusiones, cfg)
    return _arm(tables.intentos_bkp, keep, cfg, SOURCE_BACKUP, cfg.backup_min_period)


def effective_attempts_tagged(registro: DataFrame, cfg: ProfileConfig, keep_effective: Callable) -> DataFrame:
    """D2 and D3 together from one table that holds both logs, told apart by ``fuente``: one scan, one join."""
    recent = F.col("periodo").try_cast("int") >= F.lit(cfg.backup_min_period)
    df = registro.where(F.col("campaign_name").isin(list(cfg.campaigns)))
    df = df.where((F.col("fuente") == SOURCE_LIVE) | ((F.col("fuente") == SOURCE_BACKUP) & recent))
    return _attempt_columns(keep_effective(df), F.col("fuente"), cfg)


def rank_attempts(union: DataFrame) -> DataFrame:
    """``orden`` numbered inside each source (S1), by time, over the union of D2 and D3.

    Numbered by range partitioning (``row_number_by_range``), so one client
    with a huge month of calls is spread over many tasks.
    """
    return row_number_by_range(union, ["fuente", "cu", "mes"], list(ATTEMPT_ORDER), out="orden")


def first_contacts(
    attempts: DataFrame, by_source: bool = True, drop_null_clients: bool = False
) -> DataFrame:
    """The first effective attempt per (source, client, month).

    Written as ``min(struct(order..., payload...))`` per group rather than a
    window filter: the aggregate combines on the map side, so the shuffle
    carries one row per group and map task, whatever the skew. ``by_source``
    False takes the first contact across both tables (the ``dedup`` option).
    """
    if drop_null_clients:
        attempts = attempts.where(F.col("cu").isNotNull())
    keys = ["fuente", "cu", "mes"] if by_source else ["cu", "mes"]
    firsts = attempts.groupBy(*keys).agg(
        first_row(*[F.col(c) for c in ATTEMPT_ORDER], F.col("telefono")).alias("_first")
    )
    return firsts.select(
        *(keys if by_source else [F.lit("all").alias("fuente"), *keys]),
        F.col("_first.wrap_up").alias("wrap_up"),
        F.col("_first.telefono").alias("telefono"),
        F.lit(1).cast("bigint").alias("orden"),
    ).select("fuente", "mes", "cu", "wrap_up", "telefono", "orden")
