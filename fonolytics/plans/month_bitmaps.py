"""Who was assigned in which month, kept as bitmaps between runs (D7 without re-reading old months).

The presence matrix asks only whether a client was assigned in a month. Per
month and bucket of 32,768 client ids that is one bitmap of 4 KB, made by a
partial aggregate; a year of ten million clients is some 15 MB. Bitmaps of
different months and buckets are independent, so a run reads the assignment of
the new month alone; unions over any months are ``bitmap_or_agg``, and counts
of distinct clients need no ids at all.

Client ids must be whole numbers. A null client is kept as a row without a
bitmap. Months are complete once their mark is there (``plans.incremental``);
the store has a part per list of stages.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.config import ProfileConfig
from fonolytics.plans.incremental import _DONE, mark_complete, stored_months
from fonolytics.plans.materialize import folder
from fonolytics.sources.tables import string_partitions

SCHEMA = "bloque bigint, mapa binary, codmes string"
# Fixed value: bits of one of Spark's bitmaps.
BITS = 32768
# Places that are taken out of a bitmap together, and bytes that are looked at first.
WORD, PIECE = 32, 128


def month_bitmaps(asignacion: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """(codmes, bloque, mapa): the clients of the configured stages, per month. A null client has a null block."""
    inside = asignacion.where(F.col("tramo_asignacion").isin(list(cfg.stages)) & F.col("codmes").isNotNull())
    client = F.col("codunicocli").cast("bigint")
    made = inside.groupBy("codmes", F.bitmap_bucket_number(client).alias("bloque")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(client)).alias("mapa"))
    return made.select("bloque", F.when(F.col("bloque").isNotNull(), F.col("mapa")).alias("mapa"), "codmes")


def stages_folder(store: str, cfg: ProfileConfig) -> str:
    return f"{store.rstrip('/')}/tramos={hashlib.sha256(json.dumps([cfg.stages, cfg.normalise_text]).encode()).hexdigest()[:16]}"


def refresh_bitmaps(asignacion: DataFrame, cfg: ProfileConfig, store: str, months: Iterable[str], recompute: Iterable[str] = ()) -> list[str]:
    """Compute and write those of ``months`` that the store lacks or that are to be redone; return them.

    The scan is filtered to them, which prunes the other month partitions of the source.
    """
    spark, part = asignacion.sparkSession, stages_folder(store, cfg)
    todo = sorted((set(months) - stored_months(spark, part)) | set(recompute))
    if todo:
        for name in [f"{_DONE}/{m}" for m in todo] + [f"codmes={m}" for m in todo]:
            fs, path = folder(spark, f"{part}/{name}")
            fs.delete(path, True)
        month_bitmaps(asignacion.where(F.col("codmes").isin(todo)), cfg).write.mode("append").partitionBy("codmes").parquet(part)
        mark_complete(spark, part, todo)
    return todo


def read_bitmaps(spark: SparkSession, cfg: ProfileConfig, store: str) -> DataFrame:
    with string_partitions(spark):
        return spark.read.schema(SCHEMA).parquet(stages_folder(store, cfg))


def _words(bitmap: Column) -> Column:
    """(palabra, bits) of a bitmap's words of `WORD` places, without those of pieces that are all zero; the bytes of a word come highest first."""
    size, per_piece = WORD // 8, PIECE // (WORD // 8)
    used = F.filter(F.sequence(F.lit(0), F.lit(BITS // 8 // PIECE - 1)), lambda t: F.substring(bitmap, t * PIECE + 1, F.lit(PIECE)) != F.lit(bytes(PIECE)))
    bits = lambda w: F.conv(F.hex(F.substring(bitmap, w * size + 1, F.lit(size))), 16, 10).cast("bigint")
    word = lambda w: F.struct(w.alias("palabra"), bits(w).alias("bits"))
    return F.flatten(F.transform(used, lambda t: F.transform(F.sequence(t * per_piece, (t + 1) * per_piece - 1), word)))


def _set(bits: Column, place: Column) -> Column:
    """Whether a word's bit at ``place`` is set: places go up from the low bits of the first byte."""
    return F.getbit(bits, place.bitwiseXOR(F.lit(WORD - 8))) == 1


def presence_from_bitmaps(bitmaps: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """D7 from bitmaps: equal to ``presence_matrix`` over the assignment that they were made of.

    Bitmaps are cut into words before months meet: a row carries a word per
    month, and only places that are set in some month become rows.
    """
    window = bitmaps.where(F.col("codmes").between(cfg.period_lo, cfg.period_hi))
    # the null client: the first place of a block without a number
    nobody = F.array(F.struct(F.lit(0).alias("palabra"), F.lit(1 << WORD - 8).cast("bigint").alias("bits")))
    words = window.select("bloque", "codmes", F.explode(F.when(F.col("bloque").isNull(), nobody).otherwise(_words(F.col("mapa")))).alias("w"))
    words = words.select("bloque", "codmes", "w.palabra", "w.bits").where("bits != 0")
    # a word's months: as many as the window has, some 20 bytes each
    met = words.groupBy("bloque", "palabra").agg(F.collect_list(F.struct("codmes", "bits")).alias("meses"), F.bit_or("bits").alias("alguno"))
    set_places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda p: _set(F.col("alguno"), p))
    ids = met.select("bloque", "palabra", "meses", F.explode(set_places).alias("sitio"))
    present = F.transform(F.filter("meses", lambda m: _set(m["bits"], F.col("sitio"))), lambda m: m["codmes"])
    found = ids.select("bloque", (F.col("palabra") * WORD + F.col("sitio")).alias("lugar"), present.alias("meses"))
    client = F.when(F.col("bloque") >= 1, (F.col("bloque") - 1) * BITS + F.col("lugar") + 1).otherwise(F.col("bloque") * BITS - F.col("lugar"))
    return found.select(
        client.cast("bigint").alias("cu"),
        F.size("meses").cast("bigint").alias("meses_asignados"),
        *[F.array_contains("meses", p).cast("int").alias(f"pres_{label}") for p, label in cfg.months],
    )


def assigned_clients(bitmaps: DataFrame, months: Iterable[str]) -> DataFrame:
    """Per month the number of known clients, and of those assigned in it or in an earlier one of ``months``.

    Counted from the bitmaps: no client id is read. A row per month and block
    goes to each later month, so to as many as there are months.
    """
    listed = sorted(set(months))
    known = bitmaps.where(F.col("bloque").isNotNull() & F.col("codmes").isin(listed))
    later = F.filter(F.array(*map(F.lit, listed)), lambda m: m >= F.col("codmes"))
    merged = known.select("*", F.explode(later).alias("hasta")).groupBy("hasta", "bloque").agg(
        F.bitmap_or_agg("mapa").alias("todos"), F.sum(F.when(F.col("codmes") == F.col("hasta"), F.bitmap_count("mapa"))).alias("n"))
    return merged.groupBy(F.col("hasta").alias("codmes")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("clientes"), F.sum(F.bitmap_count("todos")).alias("clientes_acumulados"))
