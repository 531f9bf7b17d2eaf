"""Cutting lineage: Parquet tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def _context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # Connect sessions have no SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    sc = _context(spark)
    sc_dir = sc.getCheckpointDir() if sc is not None else None
    if sc_dir:
        return sc_dir
    return spark.conf.get(CHECKPOINT_CONF, None) or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the session's checkpoint folder; set one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset on a ``local[...]`` master (local runs and
    tests) a fresh folder is created, under ``fallback`` if given; a cluster
    without a shared checkpoint folder is an error, never a machine-local one.
    """
    sc = _context(spark)
    current = checkpoint_dir(spark)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc is not None else None) or current
    if sc is not None and not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    base = fallback or tempfile.mkdtemp(prefix="fonolytics-ckpt-")
    os.makedirs(base, exist_ok=True)
    if sc is not None:
        sc.setCheckpointDir(base)
    try:
        spark.conf.set(CHECKPOINT_CONF, base)
    except Exception:  # a platform may refuse core settings at run time
        if sc is None:
            raise
    return (sc.getCheckpointDir() if sc is not None else None) or base


def materialize(df: DataFrame, how: str = "none") -> DataFrame:
    """``none``: keep the plan; ``checkpoint``: write a Parquet table in the shared folder and read it back.

    A lost executor costs a re-read, not a recomputation of the whole lineage,
    and readers take only the columns they need, with the table's true size
    known to the planner. (Local checkpoints live on executors and die with
    them: never used.)
    """
    if how == "none":
        return df
    if how == "checkpoint":
        path = scratch_path(df.sparkSession, "table")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    raise ValueError(f"unknown materialisation {how!r}")


def materialize_shared(df: DataFrame) -> DataFrame:
    """``materialize``, with one written copy for equal plans over the same files while these don't change.

    Plans without files (rows made in the program), or over many, are written each time.
    """
    spark = df.sparkSession
    stamp = _input_stamp(spark, df.inputFiles())
    if stamp is None:
        return materialize(df, "checkpoint")
    key = (ensure_checkpoint_dir(spark), df.semanticHash(), stamp)
    for plan, path in _SHARED.get(key, []):
        if folder(spark, path)[0].exists(folder(spark, path)[1]) and plan.sameSemantics(df):
            return spark.read.schema(df.schema).parquet(path)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    _SHARED.setdefault(key, []).append((df, path))
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str) -> tuple:
    """Hadoop file system and path object of a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _input_stamp(spark: SparkSession, files: list[str], most: int = 1000) -> tuple | None:
    """Name, length and time of change of each file; None for no files, too many, or none that can be asked for."""
    if not files or len(files) > most or _context(spark) is None:
        return None
    found = []
    for name in sorted(files):
        fs, path = folder(spark, name)
        status = fs.getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


_SCRATCH: list[str] = []
_SHARED: dict[tuple, list[tuple[DataFrame, str]]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared checkpoint folder, which ``release`` removes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch paths made after the first ``since`` ones. No result that reads them may be used afterwards."""
    for path in _SCRATCH[since:]:
        fs, p = folder(spark, path)
        fs.delete(p, True)
    gone = set(_SCRATCH[since:])
    for key, copies in list(_SHARED.items()):
        _SHARED[key] = [c for c in copies if c[1] not in gone]
    del _SCRATCH[since:]


def scratch_count() -> int:
    """How many scratch paths there are: what a job that cleans up after itself passes to ``release``."""
    return len(_SCRATCH)
