"""Contact matrix, target-month contact, month cells and the client profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.config import (
    LABEL_CONTACTED,
    LABEL_NOT_CONTACTED,
    LABEL_TARGET_CONTACT,
    LABEL_TARGET_NO_CONTACT,
    ProfileConfig,
)
from fonolytics.functions.phones import clean_phone, month_cell, month_phone


def contact_matrix(firsts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client, ``<month>_res`` = 'ce' and ``<month>_tlf`` = phone of the first contact.

    Two first contacts in one month (one per source, S1) collapse by ``max``:
    the larger phone string wins, not the earlier call (S2).
    """
    window = firsts.where(F.col("mes").between(cfg.period_lo, cfg.period_hi))
    mes = F.col("mes")
    return window.groupBy("cu").agg(
        *[F.max(F.when(mes == p, F.lit(LABEL_CONTACTED))).alias(f"{label}_res") for p, label in cfg.months],
        *[F.max(F.when(mes == p, F.col("telefono"))).alias(f"{label}_tlf") for p, label in cfg.months],
    )


def target_period_contact(firsts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """First contact(s) of the target month; one row per source, not de-duplicated."""
    return firsts.where(F.col("mes") == F.lit(cfg.target_period)).select(
        "cu",
        F.lit(LABEL_TARGET_CONTACT).alias(cfg.target_result_col),
        F.col("telefono").alias("tlf_mejor_resultado"),
    )


def month_status_columns(cfg: ProfileConfig, pres=None, res=None, tlf=None) -> list[Column]:
    """D11 as expressions over joined presence (``pres_*``) and contact (``*_res``, ``*_tlf``) columns."""
    pres = pres or (lambda label: F.col(f"pres_{label}"))
    res = res or (lambda label: F.col(f"{label}_res"))
    tlf = tlf or (lambda label: F.col(f"{label}_tlf"))
    return [
        *[month_cell(pres(label), res(label), LABEL_NOT_CONTACTED).alias(label) for label in cfg.labels],
        *[month_phone(pres(label), tlf(label)).alias(f"{label}_tlf") for label in cfg.labels],
    ]


def month_status(presence: DataFrame, contacts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """D11 on its own: every client with a presence row, with its month cells."""
    p, h = presence.alias("p"), contacts.alias("h")
    return p.join(h, F.col("p.cu") == F.col("h.cu"), "left").select(
        F.col("p.cu").alias("cu"),
        *month_status_columns(
            cfg,
            pres=lambda label: F.col(f"p.pres_{label}"),
            res=lambda label: F.col(f"h.{label}_res"),
            tlf=lambda label: F.col(f"h.{label}_tlf"),
        ),
    )


def contact_summary(firsts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """D8 and D9 in one aggregation per client.

    Besides the month columns of D8, ``_target`` lists the first contacts of
    the target month, one per source (at most the number of sources, so the
    list is bounded), which the profile explodes to reproduce the joins of
    D9: two sources in the target month give two profile rows (S2). One pass
    over the first contacts instead of two.
    """
    window = firsts.where(F.col("mes").between(cfg.period_lo, cfg.period_hi))
    mes = F.col("mes")
    target = F.when(mes == F.lit(cfg.target_period), F.struct(F.col("telefono").alias("tlf")))
    return window.groupBy("cu").agg(
        *[F.max(F.when(mes == p, F.lit(LABEL_CONTACTED))).alias(f"{label}_res") for p, label in cfg.months],
        *[F.max(F.when(mes == p, F.col("telefono"))).alias(f"{label}_tlf") for p, label in cfg.months],
        F.collect_list(target).alias("_target"),
    )


def client_profile(
    snapshot: DataFrame,
    presence: DataFrame,
    summary: DataFrame,
    cfg: ProfileConfig,
    columns: list[str] | None = None,
    copies: str | None = None,
) -> DataFrame:
    """D12 (Query 1): snapshot left-joined to presence and the contact summary.

    ``summary`` is ``contact_summary`` (D8 + D9). ``columns`` restricts the
    snapshot columns carried; by default all of them (``c.*``). Both joins
    are on the client id, and both right sides come out of aggregations
    hash-partitioned on it. ``copies`` names an extra column with the number
    of rows that the client has (S2).
    """
    c = snapshot.alias("c")
    keep = columns if columns is not None else snapshot.columns
    p, h = presence.alias("p"), summary.alias("h")
    joined = c.join(p, F.col("c.codunicocli") == F.col("p.cu"), "left").join(
        h, F.col("c.codunicocli") == F.col("h.cu"), "left"
    )
    flat = joined.select(
        *[F.col(f"c.{name}").alias(name) for name in keep],
        F.col("p.meses_asignados").alias("_meses"),
        *[F.col(f"p.pres_{label}").alias(f"_pres_{label}") for label in cfg.labels],
        *[F.col(f"h.{label}_res").alias(f"_res_{label}") for label in cfg.labels],
        *[F.col(f"h.{label}_tlf").alias(f"_tlf_{label}") for label in cfg.labels],
        F.greatest(F.coalesce(F.size("h._target"), F.lit(0)), F.lit(1)).alias("_n"),
        F.explode_outer(F.col("h._target")).alias("_t"),
    )
    return flat.select(
        *keep,
        F.when(F.col("_t").isNotNull(), F.lit(LABEL_TARGET_CONTACT)).otherwise(F.lit(LABEL_TARGET_NO_CONTACT)).alias(cfg.summary_col),
        F.col("_t.tlf").alias("tlf_mejor_resultado"),
        *[clean_phone(F.col(raw)).alias(clean) for raw, clean in zip(cfg.phone_cols, cfg.clean_cols)],
        F.coalesce(F.col("_meses"), F.lit(0).cast("bigint")).alias("meses_con_gestion"),
        *month_status_columns(
            cfg,
            pres=lambda label: F.col(f"_pres_{label}"),
            res=lambda label: F.col(f"_res_{label}"),
            tlf=lambda label: F.col(f"_tlf_{label}"),
        ),
        *([F.col("_n").alias(copies)] if copies else []),
    )
