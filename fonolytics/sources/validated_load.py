"""Select a file, validate it, truncate the target and load it.

The business case loads spreadsheets through a four-step screen; here the
same steps are one batch job over any format Spark reads (CSV, parquet, ...;
spreadsheets would be exported to CSV first). Rows failing a rule go to a
quarantine table with the first rule they broke and with all of them. The
counts of the load are observed while the rows are written, so they need no
second read and can't differ from the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fonolytics.plans.materialize import materialize, release, scratch_count

VALID = "valido"
QUARANTINE = "cuarentena"
# Rule names, in the order they are checked.
R_KEY_NULL = "clave_nula"
R_KEY_DUPLICATE = "clave_duplicada"
R_AMOUNT_TEXT = "monto_no_numerico"
R_AMOUNT_FINITE = "monto_no_finito"
R_AMOUNT = "monto_no_positivo"
R_CATEGORY = "categoria_desconocida"


@dataclass(frozen=True)
class LoadRules:
    key: str
    amount: str
    category: str
    categories: tuple[str, ...]


# The order priorities of the test tables.
ORDER_RULES = LoadRules(
    key="o_orderkey",
    amount="o_totalprice",
    category="o_orderpriority",
    categories=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
)


RULE_NAMES = (R_KEY_NULL, R_KEY_DUPLICATE, R_AMOUNT_TEXT, R_AMOUNT_FINITE, R_AMOUNT, R_CATEGORY)


def _broken(rules: LoadRules, copies: Column) -> Column:
    """Names of all rules that a row breaks, in the order of ``RULE_NAMES``."""
    raw, amount = F.col(rules.amount), F.col(rules.amount).cast("string").try_cast("double")
    category = F.col(rules.category)
    # text like NaN, Infinity or 1e400 is read as a number, but no amount
    infinite = F.isnan(amount) | (F.abs(amount) == F.lit(float("inf")))
    conditions = {
        R_KEY_NULL: F.col(rules.key).isNull(),
        R_KEY_DUPLICATE: copies.isNotNull(),
        R_AMOUNT_TEXT: raw.isNotNull() & amount.isNull(),
        R_AMOUNT_FINITE: infinite,
        R_AMOUNT: raw.isNull() | (amount <= 0),
        R_CATEGORY: category.isNull() | ~category.isin(list(rules.categories)),
    }
    return F.array_compact(F.array(*[F.when(conditions[name], F.lit(name)) for name in RULE_NAMES]))


def validate(df: DataFrame, rules: LoadRules) -> DataFrame:
    """Add ``estado``, ``motivo`` (the first broken rule, null when valid) and ``motivos`` (all of them); the values stay as they came.

    The amount may be text: one that is no number, or no finite one, has a
    reason of its own. Uniqueness is checked with a key count aggregated on the
    map side and joined back; adaptive execution splits a key that holds many
    rows. Rows without a key take no part in that join.
    """
    keyed = df.where(F.col(rules.key).isNotNull())
    dup_keys = keyed.groupBy(rules.key).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)
    flagged = keyed.join(dup_keys, rules.key, "left").select(*df.columns, "_copies")
    flagged = flagged.unionByName(df.where(F.col(rules.key).isNull()).withColumn("_copies", F.lit(None).cast("bigint")))
    return flagged.withColumn("motivos", _broken(rules, F.col("_copies"))).select(
        *df.columns,
        F.when(F.size("motivos") == 0, F.lit(VALID)).otherwise(F.lit(QUARANTINE)).alias("estado"),
        F.get("motivos", F.lit(0)).alias("motivo"),
        "motivos",
    )


def load_summary(validated: DataFrame) -> DataFrame:
    """Rows per status and first reason: what the screen reports after a load."""
    return validated.groupBy("estado", "motivo").agg(F.count(F.lit(1)).alias("filas"))


def rule_counts(validated: DataFrame) -> DataFrame:
    """Rows that break each rule; a row counts for every rule that it breaks."""
    return validated.select(F.explode("motivos").alias("motivo")).groupBy("motivo").agg(F.count(F.lit(1)).alias("filas"))


SUMMARY = "estado string, motivo string, filas long, filas_con_motivo long"


def load_checked(df: DataFrame, target: str, quarantine: str, rules: LoadRules, schema: T.StructType | str | None = None) -> DataFrame:
    """Validate ``df``, overwrite ``quarantine`` with the rejected rows and ``target`` with the valid ones; return the accounting.

    One row per status and first reason that occurs: ``filas``, and
    ``filas_con_motivo``, all rows that break that rule (null for valid rows);
    a rule that only occurs behind another has ``filas`` 0. The counts are
    observed in the pass that writes the checked rows to the shared folder.
    Both tables are published from there, the target last, so a failure never
    loses rejects.
    """
    spark = df.sparkSession
    before = scratch_count()
    seen = Observation("validated load")
    first = [F.count_if(F.col("motivo") == name).alias(f"first_{name}") for name in RULE_NAMES]
    every = [F.count_if(F.array_contains("motivos", name)).alias(f"all_{name}") for name in RULE_NAMES]
    checked = materialize(validate(df, rules).observe(seen, F.count_if(F.col("estado") == VALID).alias("valid"), *first, *every), "checkpoint")
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in types] if types is not None else df.columns
    checked.where(F.col("estado") == QUARANTINE).write.mode("overwrite").parquet(quarantine)
    checked.where(F.col("estado") == VALID).select(*typed).write.mode("overwrite").parquet(target)
    release(spark, before)
    counts = seen.get
    rows = [(VALID, None, counts["valid"], None)] if counts["valid"] else []
    rows += [(QUARANTINE, name, counts[f"first_{name}"], counts[f"all_{name}"]) for name in RULE_NAMES if counts[f"all_{name}"]]
    return spark.createDataFrame(rows, SUMMARY)


def validated_load(
    spark: SparkSession,
    source: str,
    target: str,
    quarantine: str,
    rules: LoadRules,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Read ``source``, then ``load_checked``.

    Text formats are read as text, so the quarantine keeps what stood in the
    file; ``schema`` gives the types that the valid rows get in the target.
    """
    df = spark.read.format(fmt).options(**(options or {"header": "true"})).load(source)
    return load_checked(df, target, quarantine, rules, schema)
