"""Re-rank a client's assigned phones by how often each produced contact.

The business case crosses client phones with score tables to raise
contactability. Two scores: ``phone_scores`` counts a phone's effective
attempts; ``scores_asof`` looks up a score table for the score that was valid
at a given time. The slots are re-ordered by score (ties keep the old slot
order) and written back as ``telefono1..N``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonolytics.config import ProfileConfig
from fonolytics.operators.sorted_scan import asof_join


def phone_scores(effective: DataFrame) -> DataFrame:
    """Effective attempts per (client, phone), combined map-side."""
    return effective.where(F.col("cu").isNotNull()).groupBy(
        F.col("cu").alias("codunicocli"), F.col("telefono")
    ).agg(F.count(F.lit(1)).alias("score"))


def phone_rescore(assigned_long: DataFrame, scores: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client: phones in the new order, and how many slots changed.

    ``assigned_long`` is (codunicocli, posicion, telefono) from the snapshot,
    at most ``n_phones`` rows per client, so the per-client window is bounded.
    """
    return rank_slots(assigned_long.join(scores, ["codunicocli", "telefono"], "left"), cfg)


def scores_asof(requests: DataFrame, history: DataFrame, time: str, strict: bool = False) -> DataFrame:
    """``requests`` (codunicocli, telefono, ``time``, ...) with the score of that phone that was valid then.

    ``history`` is a score table: codunicocli, telefono, vigente_desde,
    puntaje, id_puntaje; a score is valid from vigente_desde (``strict``: after
    it) until the next one of its phone. Of scores that begin together the one
    with the greatest id counts. Adds puntaje and vigente_desde, null where no
    score was valid yet. However many scores or requests a client has, no
    pairs are made and no task holds a client (``asof_join``).
    """
    return asof_join(requests, history, ["codunicocli", "telefono"], time, "vigente_desde",
                     ["puntaje", "vigente_desde"], tie=["id_puntaje"], strict=strict)


def phone_rescore_asof(assigned_long: DataFrame, history: DataFrame, cfg: ProfileConfig, time: str = "fecha") -> DataFrame:
    """R6 against a score table: each client's phones in the order of the scores valid at the row's ``time``.

    Phones without a score by then come last (score 0); ties keep the old slot order.
    """
    scored = scores_asof(assigned_long.select("codunicocli", "posicion", "telefono", time), history, time)
    return rank_slots(scored.withColumnRenamed("puntaje", "score"), cfg)


def rank_slots(scored: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client: phones by falling ``score`` (null counts as 0), and how many slots changed."""
    scored = scored.withColumn("score", F.coalesce(F.col("score").cast("bigint"), F.lit(0).cast("bigint")))
    w = Window.partitionBy("codunicocli").orderBy(F.col("score").desc(), F.col("posicion").asc())
    ranked = scored.withColumn("nueva_posicion", F.row_number().over(w))
    pos = F.col("nueva_posicion")
    return ranked.groupBy("codunicocli").agg(
        *[F.max(F.when(pos == k, F.col("telefono"))).alias(f"telefono{k}") for k in range(1, cfg.n_phones + 1)],
        F.sum(F.when(pos != F.col("posicion"), 1).otherwise(0)).alias("slots_cambiados"),
        F.max("score").alias("mejor_score"),
    )
