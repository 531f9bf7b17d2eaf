"""Writing results and laying out the inputs by month.

Results (P5): the scripts hand their result set to a spreadsheet; here a
report is written as parquet or CSV in a folder per target month. Each run
writes a folder of its own and publishes it only when it is complete, in place
of the month's earlier report: a run that fails leaves that report as it was,
and one without rows leaves an empty report, not an old one.

Inputs: attempts partitioned by ``periodo`` and the assignment by ``codmes``
let Catalyst prune partitions for every month predicate of the stages (the
target month of the snapshot, the window of the presence matrix, the
backup's lower bound), so a run reads only the months it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fonolytics.config import ProfileConfig
from fonolytics.plans.materialize import folder
from fonolytics.sources.tables import ContactTables, read_contact_tables

TARGET_PERIOD_COL = "periodo_objetivo"


def write_report(
    df: DataFrame,
    path: str,
    cfg: ProfileConfig,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> None:
    """Write a result as the report of its target month, ``path/periodo_objetivo=<target>/``.

    Each task writes its own files; nothing is funnelled through one task. One
    run at a time may write a month; other months may be written meanwhile.
    """
    opts = {**({"header": "true"} if fmt == "csv" else {}), **(options or {})}
    path, month = path.rstrip("/"), cfg.target_period
    spark = df.sparkSession
    recover_report(spark, path, month)
    fresh = f"{path}/{_FRESH}{month}-{uuid.uuid4().hex}"
    rows = df.drop(TARGET_PERIOD_COL)
    try:
        rows.write.format(fmt).options(**opts).save(fresh)
    except BaseException:
        _remove(spark, fresh)
        raise
    _publish(spark, path, month, fresh)


# Folders with a leading underscore are none of the report's to Spark's readers.
_FRESH, _OLD = "_nuevo-", "_anterior-"


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = folder(spark, path)
    fs.delete(p, True)


def _publish(spark: SparkSession, path: str, month: str, fresh: str) -> None:
    """Put the complete folder ``fresh`` in the month's place: the old report steps aside, and goes last."""
    target, old = f"{path}/{TARGET_PERIOD_COL}={month}", f"{path}/{_OLD}{month}"
    fs, place = folder(spark, target)
    aside = folder(spark, old)[1]
    if fs.exists(place) and not fs.rename(place, aside):
        raise OSError(f"can't move {target}")
    if not fs.rename(folder(spark, fresh)[1], place):
        fs.rename(aside, place)
        raise OSError(f"can't publish {fresh}")
    fs.delete(aside, True)


def recover_report(spark: SparkSession, path: str, month: str) -> None:
    """Tidy up after a run of this month that was lost: its unpublished files go, a report that it moved aside comes back."""
    fs, root = folder(spark, path)
    if not fs.exists(root):
        return
    target = folder(spark, f"{path}/{TARGET_PERIOD_COL}={month}")[1]
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name == f"{_OLD}{month}" and not fs.exists(target):
            fs.rename(status.getPath(), target)
        elif name == f"{_OLD}{month}" or name.startswith(f"{_FRESH}{month}-"):
            fs.delete(status.getPath(), True)


def write_inputs_by_period(tables: ContactTables, root: str, fmt: str = "parquet") -> dict[str, str]:
    """Lay the four inputs out under ``root`` partitioned by month; return their paths."""
    root = root.rstrip("/")
    paths = {name: f"{root}/{name}" for name in ("intentos", "intentos_bkp", "conclusiones", "asignacion")}
    tables.intentos.write.mode("overwrite").format(fmt).partitionBy("periodo").save(paths["intentos"])
    tables.intentos_bkp.write.mode("overwrite").format(fmt).partitionBy("periodo").save(paths["intentos_bkp"])
    tables.conclusiones.write.mode("overwrite").format(fmt).save(paths["conclusiones"])
    tables.asignacion.write.mode("overwrite").format(fmt).partitionBy("codmes").save(paths["asignacion"])
    return paths


def read_inputs_by_period(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> ContactTables:
    return read_contact_tables(spark, paths, fmt)
