"""Input tables of the contact jobs: schemas, renames and readers.

The scripts read four tables by name and never declare them; the schemas
below are the inferred ones (SURVEY 1.2). Column names with spaces or hyphens
are renamed to snake_case once, at ingest, so nothing downstream needs
backticks.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fonolytics.config import SOURCE_BACKUP, SOURCE_LIVE

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("periodo", T.StringType()),
    T.StructField("contact_id", T.LongType()),
    T.StructField("wrap_up", T.StringType()),
    T.StructField("dnis", T.StringType()),
    T.StructField("fecha_key", T.TimestampType()),
    T.StructField("id_intento", T.LongType()),
    T.StructField("campaign_name", T.StringType()),
])

OUTCOME_SCHEMA = T.StructType([
    T.StructField("conlusion_cloud", T.StringType()),
    T.StructField("tipo_resultado", T.StringType()),
])


def assignment_schema(n_phones: int = 10, phone_type: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("codunicocli", T.LongType()),
            T.StructField("codmes", T.StringType()),
            T.StructField("tramo_asignacion", T.StringType()),
            T.StructField("id_asignacion", T.LongType()),
            T.StructField("saldo", T.DoubleType()),
        ]
        + [T.StructField(f"telefono{k}", phone_type) for k in range(1, n_phones + 1)]
    )


# Source names as they appear in the call-centre tables -> our names.
ATTEMPT_RENAMES = {
    "contact id": "contact_id",
    "wrap-up": "wrap_up",
    "campaign name": "campaign_name",
}


@dataclass(frozen=True)
class ContactTables:
    """The four logical inputs, already renamed to canonical columns."""

    intentos: DataFrame        # live attempts
    intentos_bkp: DataFrame    # backup attempts
    conclusiones: DataFrame    # outcome catalogue
    asignacion: DataFrame      # monthly assignment history
    # both attempt logs in one table, told apart by ``fuente`` (live or bkp), where there is one: read once
    registro: DataFrame | None = None


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def normalise_text(tables: ContactTables) -> ContactTables:
    """Lower-case and trim the code columns (the option for S24)."""

    def norm(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in cols})

    return ContactTables(
        intentos=norm(tables.intentos, ["wrap_up", "campaign_name"]),
        intentos_bkp=norm(tables.intentos_bkp, ["wrap_up", "campaign_name"]),
        conclusiones=norm(tables.conclusiones, ["conlusion_cloud", "tipo_resultado"]),
        asignacion=norm(tables.asignacion, ["tramo_asignacion"]),
        registro=norm(tables.registro, ["wrap_up", "campaign_name"]) if tables.registro is not None else None,
    )


@contextmanager
def string_partitions(spark: SparkSession):
    """Month folder names like ``202601`` must stay strings (months are compared as text)."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def read_contact_tables(
    spark: SparkSession,
    paths: dict[str, str],
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> ContactTables:
    """Read the four tables from storage (parquet, orc, csv, json, ...).

    ``paths`` maps ``intentos``, ``intentos_bkp``, ``conclusiones`` and
    ``asignacion`` to locations; ``registro`` instead of the first two names a
    table of both logs with a column ``fuente`` (live or bkp). Parquet/ORC keep their own schema (and any
    extra assignment columns, which the profile passes through); text formats
    are read as text by column name (a CSV file needs its header), renamed,
    and the known columns cast to the schemas above, malformed values to null;
    columns beyond those pass through as text, and there may be any number of
    phone slots. Folders partitioned by month keep their values as strings.
    """
    opts = {"csv": {"header": "true"}, "json": {"primitivesAsString": "true"}}.get(fmt, {}) | dict(options or {})

    def read(name: str, schema: T.StructType) -> DataFrame:
        df = rename_columns(spark.read.format(fmt).options(**opts).load(paths[name]), ATTEMPT_RENAMES)
        if fmt not in ("csv", "json"):
            return df
        kinds = {f.name: f.dataType for f in schema}
        phone = kinds.get("telefono1")
        known = {c: kinds.get(c, phone if re.fullmatch(r"telefono\d+", c) else None) for c in df.columns}
        return df.withColumns({c: F.col(c).try_cast(t) for c, t in known.items() if t is not None})

    with string_partitions(spark):
        both = read("registro", ATTEMPT_SCHEMA) if "registro" in paths else None
        arm = lambda source: both.where(F.col("fuente") == source).drop("fuente")
        return ContactTables(
            intentos=read("intentos", ATTEMPT_SCHEMA) if both is None else arm(SOURCE_LIVE),
            intentos_bkp=read("intentos_bkp", ATTEMPT_SCHEMA) if both is None else arm(SOURCE_BACKUP),
            registro=both,
            conclusiones=read("conclusiones", OUTCOME_SCHEMA),
            asignacion=read("asignacion", assignment_schema()),
        )
