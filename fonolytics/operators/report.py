"""Alert columns for the one-row-per-client report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonolytics.config import ALERT_A1, ALERT_A2, ALERT_A3, FLAG_NO, FLAG_YES, POSITIONS_PREFIX, ProfileConfig
from fonolytics.functions.phones import joined_positions, position_list
from fonolytics.operators.alerts import CONTACTS, COPIES, SLOTS


def a1_positions(priority: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client, the distinct slots of A1 contacts as a comma list."""
    return (
        priority.where(F.col("tipo_alerta") == ALERT_A1)
        .groupBy("codunicocli")
        .agg(position_list(F.col("posicion_en_asignacion"), cfg.numeric_positions).alias("posiciones"))
    )


def a2_clients(priority: DataFrame) -> DataFrame:
    """Clients with at least one A2 contact."""
    return priority.where(F.col("tipo_alerta") == ALERT_A2).select("codunicocli").distinct()


def a3_positions(dead: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client, the distinct slots of A3 phones as a comma list."""
    return dead.groupBy("codunicocli").agg(
        position_list(F.col("posicion_en_asignacion"), cfg.numeric_positions).alias("posiciones")
    )


def client_profile_alerts(facts: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """D22 (Query 4): the profile plus four alert columns, from the row's own contacts and slots.

    The lists are distinct per client and equal on every copy of its row, so
    each row makes its own: no join and no shuffle after the profile. A null
    client id reads 'NO' (S20).
    """
    known = F.col("codunicocli").isNotNull()
    used = lambda s: F.exists(CONTACTS, lambda c: c["telefono"] == s["telefono"])
    wrong = F.filter(SLOTS, lambda s: (s["posicion"] > 1) & used(s))
    dead = F.filter(SLOTS, lambda s: ~used(s))
    missing = known & F.exists(CONTACTS, lambda c: ~F.exists(SLOTS, lambda s: s["telefono"] == c["telefono"]))

    def places(slots: Column) -> Column:
        text = joined_positions(F.transform(slots, lambda s: s["posicion"]), cfg.numeric_positions)
        return F.when(known & (F.size(slots) > 0), F.concat(F.lit(POSITIONS_PREFIX), text)).otherwise(F.lit(FLAG_NO))

    a1, a2, a3 = "A1_score_mal_priorizado", "A2_telefono_no_asignado", "A3_telefono_sin_contacto"
    out = facts.withColumns({a1: places(wrong), a2: F.when(missing, F.lit(FLAG_YES)).otherwise(F.lit(FLAG_NO)), a3: places(dead)})
    quiet = (F.col(a1) == FLAG_NO) & (F.col(a2) == FLAG_NO) & (F.col(a3) == FLAG_NO)
    flag = F.when(quiet, F.lit(FLAG_NO)).otherwise(F.lit(FLAG_YES)).alias("necesita_revision")
    own = [c for c in facts.columns if c not in (COPIES, CONTACTS, SLOTS)]
    return out.select(*own, flag, a1, a2, a3)
