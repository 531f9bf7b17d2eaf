"""First effective contact per (source, client, month), maintained as attempts arrive.

Streaming form of D5. The stream keeps the running ``min(struct(order...))``
per group in the state store and, in update mode, emits only the groups a
micro-batch improved. ``min`` is idempotent and order-free, so the sink is an
append-only change log (plain parquet, no merge support needed) and a reader
takes the ``min`` again: replaying a batch after a failure changes nothing.

By default no row is ever dropped: the state holds one row per (source,
client, month), which is what the result holds too. A caller who accepts that
calls older than a delay are ignored can pass ``watermark_delay``: the running
minimum is then kept per calendar day of the call, and Spark drops a day's
state once the watermark passes it. ``dropped_rows`` tells how many rows a
query ignored that way; stored history is better read by the batch stage.
A new outcome code is seen by a query from its next start on.

The log holds one row per improvement. ``compact`` rewrites it to one row per
group as a new version and then switches a pointer, so readers see the old or
the new version, never a mixture. A log without any row reads as empty.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fonolytics.config import SOURCE_BACKUP, SOURCE_LIVE, ProfileConfig
from fonolytics.operators.attempts import ATTEMPT_ORDER, _arm
from fonolytics.plans.materialize import ensure_checkpoint_dir, folder, scratch_path

_FIRST = "_first"
_EVENT = "_evento"
# Below the log's folder: improvements, compacted versions, and a pointer file per complete version.
_LOG, _VERSION, _POINTER = "log", "version-", "complete-"
GROUP_KEYS = ["fuente", "cu", "mes"]
# Fixed value: micro-batches that the attempts of the test tables come in.
DELIVERIES = 4
_TYPES = {"fuente": "string", "cu": "bigint", "mes": "string", "wrap_up": "string"}
_FIRST_TYPE = "struct<fecha_key: timestamp, id_intento: bigint, dnis: string, wrap_up: string, telefono: string>"


def log_schema(keys: list[str]) -> str:
    return ", ".join([*[f"{k} {_TYPES[k]}" for k in keys], f"{_FIRST} {_FIRST_TYPE}"])


def first_contact_updates(arms: DataFrame, watermark_delay: str | None = None) -> DataFrame:
    """Running first contact per group (and per call day, with a watermark)."""
    keys = [F.col(k) for k in GROUP_KEYS]
    if watermark_delay:
        # event time must be a TIMESTAMP; the ordering keeps fecha_key itself
        arms = arms.withColumn(_EVENT, F.col("fecha_key").cast("timestamp")).withWatermark(_EVENT, watermark_delay)
        keys.append(F.window(_EVENT, "1 day").alias("_dia"))
    return arms.groupBy(*keys).agg(
        F.min(F.struct(*[F.col(c) for c in ATTEMPT_ORDER], F.col("telefono"))).alias(_FIRST)
    )


def effective_attempt_stream(live: DataFrame, backup: DataFrame, keep_effective, cfg: ProfileConfig) -> DataFrame:
    """Both attempt streams through the same filters as the batch D2/D3."""
    return _arm(live, keep_effective, cfg, SOURCE_LIVE, None).unionByName(
        _arm(backup, keep_effective, cfg, SOURCE_BACKUP, cfg.backup_min_period)
    )


def start_changelog_sink(
    updates: DataFrame, out_path: str, checkpoint: str, available_now: bool = True, name: str | None = None,
    keys: list[str] | None = None,
) -> StreamingQuery:
    """Append each micro-batch's improved groups to the log in ``out_path``.

    A batch that is replayed after a failure is appended again; the reader's
    minimum makes that harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*(keys or GROUP_KEYS), _FIRST).write.mode("append").parquet(f"{out_path}/{_LOG}")

    _drop_counter(updates.sparkSession)
    w = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _paths(spark: SparkSession, out_path: str) -> tuple:
    """Hadoop file system and path of the log's folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, out_path: str) -> list[str]:
    """Complete compacted versions, oldest first (a version counts once its pointer file is there)."""
    fs, path = _paths(spark, out_path)
    if not fs.exists(path(out_path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(out_path))]
    return sorted(n.removeprefix(_POINTER) for n in names if n.startswith(_POINTER))


def _log_files(spark: SparkSession, out_path: str) -> list[str]:
    """The log's data files; none where nothing was written yet."""
    fs, path = _paths(spark, out_path)
    log = path(f"{out_path}/{_LOG}")
    if not fs.exists(log):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(log)]
    return [f"{out_path}/{_LOG}/{n}" for n in names if not n.startswith(("_", "."))]


def read_log(spark: SparkSession, out_path: str, keys: list[str] | None = None) -> DataFrame:
    """One row per group: the newest compacted version and all later improvements."""
    keys = keys or GROUP_KEYS
    schema, versions = log_schema(keys), _versions(spark, out_path)
    parts = [spark.read.schema(schema).parquet(f"{out_path}/{_LOG}")] if _log_files(spark, out_path) else []
    parts += [spark.read.schema(schema).parquet(f"{out_path}/{_VERSION}{versions[-1]}")] if versions else []
    log = spark.createDataFrame([], schema) if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return log.groupBy(*keys).agg(F.min(_FIRST).alias(_FIRST))


def compact(spark: SparkSession, out_path: str, keys: list[str] | None = None) -> None:
    """Rewrite the log to one row per group.

    The new version is complete before its pointer is created; only then are
    the files that it was made from removed, one by one, and the older
    versions. After a crash at any step the newest pointer names a complete
    version, and rows that stand twice are harmless to the minimum.
    """
    fs, path = _paths(spark, out_path)
    old, files = _versions(spark, out_path), _log_files(spark, out_path)
    if not files:
        return
    name = f"{int(old[-1]) + 1 if old else 1:08d}"
    read_log(spark, out_path, keys).write.mode("overwrite").parquet(f"{out_path}/{_VERSION}{name}")
    fs.create(path(f"{out_path}/{_POINTER}{name}")).close()
    for f in files:
        fs.delete(path(f), False)
    for v in old:
        fs.delete(path(f"{out_path}/{_POINTER}{v}"), False)
        fs.delete(path(f"{out_path}/{_VERSION}{v}"), True)


class _DropCounter(StreamingQueryListener):
    """Adds up, over all progress reports of a run, the rows that its watermark made it ignore."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


_COUNTERS: dict[int, _DropCounter] = {}


def _drop_counter(spark: SparkSession) -> _DropCounter:
    if id(spark) not in _COUNTERS:
        _COUNTERS[id(spark)] = _DropCounter()
        spark.streams.addListener(_COUNTERS[id(spark)])
    return _COUNTERS[id(spark)]


def dropped_rows(query: StreamingQuery, wait: float = 20.0) -> int:
    """Rows (partial minima per task) that the watermark of a query started here made it ignore, over its whole run.

    For a query that has ended, waits up to ``wait`` seconds for its last report.
    """
    counter, run = _drop_counter(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()), str(query.runId)
    end = time.monotonic() + wait
    while not query.isActive and run not in counter.ended and time.monotonic() < end:
        time.sleep(0.05)
    return counter.rows.get(run, 0)


def read_first_contacts(spark: SparkSession, out_path: str) -> DataFrame:
    """Current first contacts from the change log, in the D5 layout."""
    return read_log(spark, out_path).select(
        "fuente", "mes", "cu",
        F.col(f"{_FIRST}.wrap_up").alias("wrap_up"),
        F.col(f"{_FIRST}.telefono").alias("telefono"),
        F.lit(1).cast("bigint").alias("orden"),
    )


def start_first_contact_stream(
    spark: SparkSession,
    live_dir: str,
    backup_dir: str,
    conclusiones: DataFrame,
    cfg: ProfileConfig,
    out_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    watermark_delay: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Keep first contacts current from two folders of attempt files.

    New files in ``live_dir`` / ``backup_dir`` (canonical attempt columns,
    see ``sources.tables.ATTEMPT_SCHEMA``) are read as they land; improved
    first contacts are appended to ``out_path``, which ``read_first_contacts``
    turns into the D5 layout. ``checkpoint`` must be a shared folder.
    """
    from fonolytics.operators.attempts import outcome_filter
    from fonolytics.sources.tables import ATTEMPT_SCHEMA

    def stream(path: str) -> DataFrame:
        reader = spark.readStream.schema(ATTEMPT_SCHEMA).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(path)

    keep = outcome_filter(conclusiones, cfg, replicate=False)
    updates = first_contact_updates(effective_attempt_stream(stream(live_dir), stream(backup_dir), keep, cfg), watermark_delay)
    return start_changelog_sink(updates, out_path, checkpoint, available_now=available_now)


def run_fixture_stream(
    spark: SparkSession, sf_dir: str, cfg: ProfileConfig, watermark_delay: str | None = None
) -> DataFrame:
    """The streaming job over the test tables: attempts arrive as file streams (``fixture_logs``), and the
    result is read back from the change log written to the shared checkpoint folder."""
    from fonolytics.operators.attempts import outcome_filter
    from fonolytics.sources import fixtures as fx

    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/first_contact_stream/{uuid.uuid4().hex}"
    keep = outcome_filter(fx.outcome_catalogue(spark, sf_dir), cfg, replicate=False)
    updates = first_contact_updates(effective_attempt_stream(*fixture_logs(spark, sf_dir), keep, cfg), watermark_delay)
    wait_for(start_changelog_sink(updates, f"{run}/log", f"{run}/state"))
    return read_first_contacts(spark, f"{run}/log")


def fixture_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The live and the backup log of the test tables as streams of attempt files.

    Line items are joined to orders once, ahead of the streams: a join within
    them would read all orders in every micro-batch. The lines of an order are
    delivered apart, and there are about `DELIVERIES` micro-batches however
    many files the tables have.
    """
    from fonolytics.sources import fixtures as fx

    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.read.schema(schema).parquet(f"{sf_dir}/lineitem*.parquet")
    attempts = fx.tagged(fx.attempts_from(lines, fx.table(spark, sf_dir, "orders")))
    path = scratch_path(spark, "attempt-log")
    turn = F.coalesce(F.pmod("id_intento", F.lit(DELIVERIES)), F.lit(0)).alias("entrega")
    attempts.select("*", turn).write.partitionBy("fuente", "entrega").parquet(path)

    def stream(source: str) -> DataFrame:
        fs, log = folder(spark, f"{path}/fuente={source}")
        fs.mkdirs(log)  # a log without any attempt
        n_files = fs.getContentSummary(log).getFileCount()
        reader = spark.readStream.schema(attempts.drop("fuente").schema).option("recursiveFileLookup", "true")
        return reader.option("maxFilesPerTrigger", max(1, -(-n_files // DELIVERIES))).parquet(f"{path}/fuente={source}")

    return stream(SOURCE_LIVE), stream(SOURCE_BACKUP)


def wait_for(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
