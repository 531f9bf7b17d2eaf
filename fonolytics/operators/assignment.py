"""Monthly assignment: target-month snapshot, presence matrix, clean phones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.config import ProfileConfig
from fonolytics.functions.phones import clean_phone

def assignment_snapshot(
    asignacion: DataFrame, cfg: ProfileConfig, order: tuple[str, ...] | None = None
) -> DataFrame:
    """Clients assigned in the target month in the configured stages, one row each.

    Keeps every assignment column plus ``rn`` (always 1), as the scripts'
    ``c.*`` does (S25). The row is the smallest by ``order`` (by default the
    configured one; the scripts leave it arbitrary, S5), then by the other columns; a null client id
    forms one group of its own and keeps one row (S20). Aggregated with
    ``min(struct)``, which combines map-side before the shuffle.
    """
    cols = asignacion.columns
    # a table without these columns is ordered by all the columns that it has
    order = tuple(c for c in (order or cfg.snapshot_order) if c in cols)
    snap = asignacion.where(
        (F.col("codmes") == F.lit(cfg.target_period)) & F.col("tramo_asignacion").isin(list(cfg.stages))
    )
    # by name, so that ties do not depend on the order of the file's columns
    payload = sorted(c for c in cols if c != "codunicocli")
    picked = snap.groupBy("codunicocli").agg(
        F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *payload)).alias("_row")
    )
    return picked.select(
        *[F.col("codunicocli") if c == "codunicocli" else F.col(f"_row.{c}").alias(c) for c in cols],
        F.lit(1).cast("bigint").alias("rn"),
    )


def presence_matrix(asignacion: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Per client, distinct assigned months in the window and a 0/1 flag per month.

    The window is a string range (``between`` lowest and highest period), as
    in the scripts, so a month outside the list but inside the range counts
    in ``meses_asignados`` without a flag.
    """
    inside = asignacion.where(
        F.col("codmes").between(cfg.period_lo, cfg.period_hi)
        & F.col("tramo_asignacion").isin(list(cfg.stages))
    )
    return inside.groupBy(F.col("codunicocli").alias("cu")).agg(
        # a set of the window's months per client: one exchange, where count_distinct needs two
        F.size(F.collect_set("codmes")).cast("bigint").alias("meses_asignados"),
        *[
            F.max(F.when(F.col("codmes") == p, F.lit(1)).otherwise(F.lit(0))).alias(f"pres_{label}")
            for p, label in cfg.months
        ],
    )


def clean_phones(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """``tlfK_limpio`` = ``telefonoK`` unless its text is exactly '0'."""
    return df.withColumns(
        {clean: clean_phone(raw) for raw, clean in zip(cfg.phone_cols, cfg.clean_cols)}
    )
