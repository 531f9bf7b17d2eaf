"""First contacts on Spark's keyed state API, with the outcome catalogue applied when they are read.

``first_contact.py`` filters attempts by the catalogue as it stands when the
query starts, so a code added later needs a restart, and calls seen before are
lost to it. Here the stream keeps the first attempt per (source, client,
month) and outcome code, whatever the code means, in its state; the reader
joins the change log with the catalogue of that moment. A code that becomes
effective midway (or stops being so) counts at once, for the calls before it
too, without touching the query.

State holds one row per group and code that occurred in it (RocksDB, on the
executors' disks, saved with the checkpoint). Without timers that is a running
minimum, which Spark keeps inside the JVM; a processor in Python would wait for
the JVM several times per group.

The change log decides, and its minimum does not mind repeated or late rows,
so state may be forgotten at any time: with ``idle_seconds`` a processor on the
keyed state API has a map and a timer per group, and closes the group once no
call came for so long; a later call opens it again. No row is dropped. The two
kinds of query can't share a checkpoint, but can follow each other on a log.

Each task first reduces its rows of a micro-batch to the first one per group
and code, so a group with a third of all calls sends a few rows per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fonolytics.config import SOURCE_BACKUP, SOURCE_LIVE, ProfileConfig
from fonolytics.operators.attempts import ATTEMPT_ORDER, _attempt_columns, effective_codes
from fonolytics.plans.materialize import ensure_checkpoint_dir
from fonolytics.streaming.first_contact import GROUP_KEYS, _FIRST, fixture_logs, read_log, start_changelog_sink, wait_for

CODE_KEYS = [*GROUP_KEYS, "wrap_up"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = [c for c in ATTEMPT_ORDER if c != "wrap_up"] + ["telefono"]
_STATE = T.StructType([
    T.StructField("fecha_key", T.LongType()),  # microseconds
    T.StructField("id_intento", T.LongType()),
    T.StructField("dnis", T.StringType()),
    T.StructField("telefono", T.StringType()),
])
_GROUP = [T.StructField("fuente", T.StringType()), T.StructField("cu", T.LongType()), T.StructField("mes", T.StringType()), T.StructField("wrap_up", T.StringType())]
_COLUMNS = T.StructType([*_GROUP, *_STATE.fields])
# Map keys can't be null: an attempt without a code is kept under a text that no code can be (codes hold no NUL).
_NO_CODE = "\x00"


def _rank(values: tuple) -> tuple:
    """Order of attempts of one code: ascending, nulls first, like a struct's."""
    return tuple((v is not None, v) for v in values)


def attempt_log_stream(live: DataFrame, backup: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Attempts of the campaigns from both logs, with any outcome; the backup from its lower bound on."""
    ours = F.col("campaign_name").isin(list(cfg.campaigns))
    recent = F.col("periodo").try_cast("int") >= F.lit(cfg.backup_min_period)
    arms = [_attempt_columns(live.where(ours), F.lit(SOURCE_LIVE), cfg), _attempt_columns(backup.where(ours & recent), F.lit(SOURCE_BACKUP), cfg)]
    return arms[0].unionByName(arms[1]).select(*CODE_KEYS, *VALUES)


def _first_per_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the first attempt per group and code."""
    order = [(c, "ascending") for c in VALUES if c != "telefono"]
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in CODE_KEYS])
            place = pa.array(range(table.num_rows), pa.int64())
            ranked = table.append_column("_place", place).take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
            ranked = ranked.append_column("_turn", place)
            first = ranked.group_by(CODE_KEYS).aggregate([("_turn", "min")])
            yield from ranked.take(first.column("_turn_min")).select(table.column_names).to_batches()


class FirstAttemptPerCode(StatefulProcessor):
    """State of one group: a map from outcome code to its first attempt. Emits the codes that a micro-batch improved."""

    def __init__(self, idle_seconds: float | None = None):
        self.idle_ms = None if idle_seconds is None else int(idle_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getMapState("primero", T.StructType([T.StructField("codigo", T.StringType())]), _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict[str, tuple] = {}
        for r in rows:
            code, new = (_NO_CODE if r.wrap_up is None else r.wrap_up), tuple(r[c] for c in VALUES)
            if code not in best or _rank(new) < _rank(best[code]):
                best[code] = new
        for code, new in best.items():
            if self.first.containsKey((code,)) and _rank(tuple(self.first.getValue((code,)))) <= _rank(new):
                continue
            self.first.updateValue((code,), new)
            yield Row(**dict(zip(_COLUMNS.names, (*key, None if code == _NO_CODE else code, *new))))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_attempt_updates(attempts: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """The running first attempt per group and code, as (group, code, first) rows when it improves."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if idle_seconds is None:
        timed = attempts.withColumn("fecha_key", F.col("fecha_key").cast("timestamp"))
        return timed.groupBy(*CODE_KEYS).agg(F.min(F.struct(*ATTEMPT_ORDER, "telefono")).alias(_FIRST))
    numbered = attempts.withColumn("fecha_key", F.unix_micros(F.col("fecha_key").cast("timestamp")))
    reduced = numbered.mapInArrow(_first_per_code, _COLUMNS)
    kept = reduced.groupBy(*GROUP_KEYS).transformWithState(FirstAttemptPerCode(idle_seconds), _COLUMNS, "Update", "ProcessingTime")
    kept = kept.withColumn("fecha_key", F.timestamp_micros("fecha_key"))
    return kept.select(*CODE_KEYS, F.struct(*ATTEMPT_ORDER, "telefono").alias(_FIRST))


def start_contact_state_stream(
    live: DataFrame, backup: DataFrame, cfg: ProfileConfig, out_path: str, checkpoint: str,
    available_now: bool = False, idle_seconds: float | None = None,
) -> StreamingQuery:
    """Keep first attempts per code current from two attempt streams; ``contacts_now`` reads them.

    Timers need a query that keeps running: with them Spark starts batches for
    as long as it is up, so a run over what is there now would never end.
    """
    if available_now and idle_seconds is not None:
        raise ValueError("idle_seconds is for queries that keep running")
    updates = first_attempt_updates(attempt_log_stream(live, backup, cfg), idle_seconds)
    return start_changelog_sink(updates, out_path, checkpoint, available_now=available_now, keys=CODE_KEYS)


def contacts_now(spark: SparkSession, out_path: str, conclusiones: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """First effective contacts by the catalogue as it is now, in the D5 layout."""
    codes = effective_codes(conclusiones, cfg).select(F.col("conclusion").alias("wrap_up"))
    known = read_log(spark, out_path, CODE_KEYS).join(codes, "wrap_up", "left_semi")
    return known.groupBy(*GROUP_KEYS).agg(F.min(_FIRST).alias(_FIRST)).select(
        "fuente", "mes", "cu",
        F.col(f"{_FIRST}.wrap_up").alias("wrap_up"),
        F.col(f"{_FIRST}.telefono").alias("telefono"),
        F.lit(1).cast("bigint").alias("orden"),
    )


def run_fixture_state_stream(spark: SparkSession, sf_dir: str, cfg: ProfileConfig) -> DataFrame:
    """The state stream over the test tables (``fixture_logs``), read with their outcome catalogue."""
    from fonolytics.sources import fixtures as fx

    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/contact_state_stream/{uuid.uuid4().hex}"
    wait_for(start_contact_state_stream(*fixture_logs(spark, sf_dir), cfg, f"{run}/log", f"{run}/state", available_now=True))
    return contacts_now(spark, f"{run}/log", fx.outcome_catalogue(spark, sf_dir), cfg)
