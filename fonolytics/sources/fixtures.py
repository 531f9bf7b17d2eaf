"""Views that turn the supplied test tables into the four contact inputs.

``orders`` plays the monthly assignment and ``lineitem`` joined to ``orders``
plays the call attempts; half-years play months (FIXTURES.md section 2). The
same definitions exist as SQL text in ``fonolytics.plans.oracle`` so the
DuckDB oracle reads identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.config import SOURCE_BACKUP, SOURCE_LIVE, ProfileConfig
from fonolytics.sources.lookup_store import identifiers_of
from fonolytics.sources.tables import ContactTables

# Fixed values of the fixture mapping (FIXTURES.md): wrap-up code = return
# flag '-' line status, and its outcome type.
FIXTURE_OUTCOME_TYPES = {
    "A-F": "pdp",
    "R-F": "contacto - efectivo",
    "N-F": "pdp - fdp",
    "A-O": "pdp",
    "R-O": "no contacto",
    "N-O": "no contacto",
}
# Order priority -> delinquency stage.
FIXTURE_STAGES = {
    "1-URGENT": "temprana",
    "2-HIGH": "intermedia",
    "3-MEDIUM": "tardia",
}
FIXTURE_OTHER_STAGE = "judicial"
# Live table holds periods from this one on; the backup holds periods up to
# it, plus the target period for every fifth client (the S1 duplicates).
FIXTURE_LIVE_FROM = "199902"
FIXTURE_BACKUP_TO = "199902"
FIXTURE_BACKUP_DUP_PERIOD = "200002"
# Days from a call to the day from which its score is valid.
SCORE_DAYS = 15
# Market segment whose customers have a CJ code.
CJ_SEGMENT = "MACHINERY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def half_year(ts: Column) -> Column:
    """``yyyy01`` for January-June, ``yyyy02`` for July-December, as string."""
    half = F.when(F.month(ts) <= 6, F.lit(1)).otherwise(F.lit(2))
    return (F.year(ts) * 100 + half).cast("string")


def period_start(period: str) -> str:
    """First day of a ``half_year`` period."""
    return f"{period[:4]}-{'01' if period.endswith('01') else '07'}-01"


def _case_map(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def dialled_slot() -> Column:
    return F.when(F.col("o_custkey") % 10 == 0, F.lit(1)).otherwise(F.col("l_partkey") % 13 + 1)


def attempts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def attempts_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Attempts from line items (batch or stream) joined to orders."""
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = F.col("o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        half_year(F.col("o_orderdate")).alias("periodo"),
        c.alias("contact_id"),
        F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("wrap_up"),
        F.concat(F.lit("51"), (F.lit(900000000) + c * 100 + dialled_slot()).cast("string")).alias("dnis"),
        F.col("l_shipdate").alias("fecha_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_intento"),
        F.concat(F.lit("cob_bpe_0"), (F.col("l_suppkey") % 5).cast("string")).alias("campaign_name"),
    )


def outcome_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct wrap-up codes that occur in the attempt log, typed by rule."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    code = F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus"))
    return li.select(
        code.alias("conlusion_cloud"),
        _case_map(code, FIXTURE_OUTCOME_TYPES).alias("tipo_resultado"),
    )


def phone_slot(c: Column, k: int) -> Column:
    """Phone in slot ``k`` of client ``c`` (FIXTURES.md column template)."""
    number = F.lit(900000000) + c * 100
    return (
        F.when(c % 10 == 1, F.lit(0))
        .when((c % 10 == 0) & F.lit(k > 1), F.lit(0))
        .when(c % 10 == 0, number + 1)
        .when((c % 10 == 2) & F.lit(k in (1, 3)), number + 1)
        .when(((c + k * 3) % 4 == 0) | ((c % 5) + 6 < k), F.lit(0))
        .otherwise(number + k)
        .cast("bigint")
    )


def assignment_history(spark: SparkSession, sf_dir: str, n_phones: int = 10) -> DataFrame:
    od = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"
    )
    c = F.col("o_custkey")
    return od.select(
        c.alias("codunicocli"),
        half_year(F.col("o_orderdate")).alias("codmes"),
        _case_map(F.col("o_orderpriority"), FIXTURE_STAGES, FIXTURE_OTHER_STAGE).alias("tramo_asignacion"),
        F.col("o_orderkey").alias("id_asignacion"),
        F.col("o_totalprice").alias("saldo"),
        *[phone_slot(c, k).alias(f"telefono{k}") for k in range(1, n_phones + 1)],
    )


def in_live() -> Column:
    return F.col("periodo") >= FIXTURE_LIVE_FROM


def in_backup() -> Column:
    again = (F.col("periodo") == FIXTURE_BACKUP_DUP_PERIOD) & (F.col("contact_id") % 5 == 0)
    return (F.col("periodo") <= FIXTURE_BACKUP_TO) | again


def tagged(attempts: DataFrame) -> DataFrame:
    """Both attempt logs in one pass: a row per log that holds the attempt, with ``fuente``."""
    logs = F.array_compact(F.array(F.when(in_live(), F.lit(SOURCE_LIVE)), F.when(in_backup(), F.lit(SOURCE_BACKUP))))
    return attempts.select("*", F.explode(logs).alias("fuente"))


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table: every line item scores the phone that it dials, from ``SCORE_DAYS`` days after its shipping on."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("codunicocli"),
        (F.lit(900000000) + F.col("o_custkey") * 100 + dialled_slot()).cast("string").alias("telefono"),
        (F.col("l_shipdate") + F.expr(f"interval {SCORE_DAYS} days")).alias("vigente_desde"),
        F.col("l_quantity").cast("long").alias("puntaje"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_puntaje"),
    )


def client_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the customers: CU = the key, DOC = a number made of it, CJ for one segment only (by nation, so it is shared)."""
    c = table(spark, sf_dir, "customer")
    doc = F.lpad((F.col("c_custkey") * 7919 + 10000019).cast("string"), 12, "0")
    cj = F.when(F.col("c_mktsegment") == CJ_SEGMENT, F.concat(F.lit("J"), F.col("c_nationkey").cast("string")))
    named = c.select("c_custkey", F.col("c_custkey").alias("cu"), doc.alias("doc"), cj.alias("cj"))
    return identifiers_of(named, "c_custkey", {"CU": "cu", "DOC": "doc", "CJ": "cj"})


def fixture_tables(spark: SparkSession, sf_dir: str, cfg: ProfileConfig | None = None) -> ContactTables:
    n_phones = cfg.n_phones if cfg is not None else 10
    att = attempts_all(spark, sf_dir)
    return ContactTables(
        intentos=att.where(in_live()),
        intentos_bkp=att.where(in_backup()),
        registro=tagged(att),
        conclusiones=outcome_catalogue(spark, sf_dir),
        asignacion=assignment_history(spark, sf_dir, n_phones),
    )
