"""Phone-quality alerts: unpivots, A1/A2/A3, alert list and client summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.config import (
    ALERT_A1,
    ALERT_A2,
    ALERT_A3,
    ALERT_OK,
    FLAG_YES,
    LABEL_CONTACTED,
    ProfileConfig,
)
from fonolytics.functions.phones import phone_key

# Columns of the profile rows that the alerts work on: copies of the client's row, and the arrays of row_facts.
COPIES, CONTACTS, SLOTS = "_copias", "_contactos", "_tlf"


def contact_phones_long(profile: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """One row per (client, month) whose cell is 'ce' and has a phone.

    A generator (``inline`` over an array of structs) unpivots the month
    pairs inside the same scan of the profile: no union of one select per
    month, so the plan stays small (SURVEY 4.1).
    """
    pairs = F.array(*[
        F.struct(F.lit(label).alias("mes"), F.col(label).alias("resultado_mes"), F.col(f"{label}_tlf").alias("telefono_ce"))
        for label in cfg.labels
    ])
    return (
        profile.select("codunicocli", F.inline(pairs))
        .where((F.col("resultado_mes") == LABEL_CONTACTED) & F.col("telefono_ce").isNotNull())
        .select("codunicocli", "mes", phone_key("telefono_ce").alias("telefono_ce"))
    )


def assigned_phones_long(profile: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """One row per (client, slot) with a clean phone; ``posicion`` 1 = best score."""
    slots = F.array(*[
        F.struct(F.lit(k).alias("posicion"), F.col(clean).alias("telefono"))
        for k, clean in enumerate(cfg.clean_cols, start=1)
    ])
    digits = cfg.phone_digits if cfg.normalise_phones else None
    return (
        profile.select("codunicocli", F.inline(slots))
        .where(F.col("telefono").isNotNull())
        .select("codunicocli", "posicion", phone_key("telefono", digits).alias("telefono"))
    )


def row_facts(profile: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """The profile rows with two arrays: ``_contactos`` (mes, telefono) and ``_tlf`` (posicion, telefono).

    Contacts and slots of a client are columns of its own row, so matching
    them needs no join: everything below is an expression over one row.
    """
    contacts = [
        F.when((F.col(label) == LABEL_CONTACTED) & F.col(f"{label}_tlf").isNotNull(),
               F.struct(F.lit(label).alias("mes"), phone_key(f"{label}_tlf").alias("telefono")))
        for label in cfg.labels
    ]
    digits = cfg.phone_digits if cfg.normalise_phones else None
    slots = [
        F.when(F.col(clean).isNotNull(), F.struct(F.lit(k).alias("posicion"), phone_key(clean, digits).alias("telefono")))
        for k, clean in enumerate(cfg.clean_cols, start=1)
    ]
    return profile.withColumns({CONTACTS: F.array_compact(F.array(*contacts)), SLOTS: F.array_compact(F.array(*slots))})


def _alert(mes: Column, phone: Column, position: Column, kind: Column) -> Column:
    return F.struct(mes.alias("mes"), phone.alias("telefono"), position.alias("posicion"), kind.alias("tipo"))


def _priority_rows() -> Column:
    """Each contact against the row's slots; a match once per copy of the client's row (S2: n rows match n rows)."""
    none = F.lit(None).cast("int")

    def against(c: Column) -> Column:
        same = F.filter(SLOTS, lambda s: s["telefono"] == c["telefono"])
        kind = lambda s: F.when(s["posicion"] == 1, F.lit(ALERT_OK)).otherwise(F.lit(ALERT_A1))
        found = F.transform(same, lambda s: _alert(c["mes"], c["telefono"], s["posicion"], kind(s)))
        missing = F.array(_alert(c["mes"], c["telefono"], none, F.lit(ALERT_A2)))
        return F.when(F.size(same) == 0, missing).otherwise(F.flatten(F.array_repeat(found, F.col(COPIES))))

    return F.flatten(F.transform(CONTACTS, against))


def _dead_rows() -> Column:
    """The row's slots whose phone none of its contacts used."""
    unused = F.filter(SLOTS, lambda s: ~F.exists(CONTACTS, lambda c: c["telefono"] == s["telefono"]))
    return F.transform(unused, lambda s: _alert(F.lit(None).cast("string"), s["telefono"], s["posicion"], F.lit(ALERT_A3)))


def alerts_priority(facts: DataFrame) -> DataFrame:
    """Each effective (client, month, phone) against the assigned slots.

    Slot 1 -> 'ok'; another slot -> A1; no slot -> A2. A phone sitting in
    slot 1 and slot n gives both 'ok' and A1 (S13).
    """
    return facts.select("codunicocli", F.inline(_priority_rows())).select(
        "codunicocli", "mes", F.col("telefono").alias("telefono_ce"), F.col("posicion").alias("posicion_en_asignacion"), F.col("tipo").alias("tipo_alerta")
    )


def alerts_dead_phones(facts: DataFrame) -> DataFrame:
    """D16 (A3): assigned phones that were never the phone of a first effective
    contact in an assigned month (S9). A null client has no contacts, so its
    phones are all A3 (S20)."""
    return facts.select("codunicocli", F.inline(_dead_rows())).select(
        "codunicocli", F.col("posicion").alias("posicion_en_asignacion"), "telefono", F.col("tipo").alias("tipo_alerta")
    )


def phone_alerts(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """D17 (Query 2): A1/A2 rows with their month and A3 rows with a null month, in one pass over the profile rows."""
    rows = F.concat(F.filter(_priority_rows(), lambda a: a["tipo"] != ALERT_OK), _dead_rows())
    out = facts.select("codunicocli", F.inline(rows)).select(
        "codunicocli", F.col("mes").alias("mes_alerta"), "telefono", F.col("posicion").alias("posicion_en_asignacion"), F.col("tipo").alias("tipo_alerta")
    )
    # Month order is alphabetical, as in the scripts.
    return out.orderBy("codunicocli", "tipo_alerta", "mes_alerta") if ordered else out


def alert_summary(alerts: DataFrame, cfg: ProfileConfig, ordered: bool = True) -> DataFrame:
    """D18 (Query 3): one row per client with an alert: flag, three counts, worst severity.

    Grouping starts from the alerts, so the flag is always 'SI' (S19).
    """
    tipo = F.col("tipo_alerta")
    rank = None
    for alert in cfg.severity:
        lvl = F.lit(cfg.severity_rank(alert))
        rank = F.when(tipo == alert, lvl) if rank is None else rank.when(tipo == alert, lvl)
    out = alerts.groupBy("codunicocli").agg(
        F.lit(FLAG_YES).alias("necesita_revision"),
        F.sum(F.when(tipo == ALERT_A1, 1).otherwise(0)).alias("cant_A1_score_mal_priorizado"),
        F.sum(F.when(tipo == ALERT_A2, 1).otherwise(0)).alias("cant_A2_telefono_no_asignado"),
        F.sum(F.when(tipo == ALERT_A3, 1).otherwise(0)).alias("cant_A3_telefono_sin_contacto"),
        F.min(rank).alias("ranking_gravedad"),
    )
    return out.orderBy("ranking_gravedad", "codunicocli") if ordered else out
