"""Run the four reports of the scripts in one job and write them.

    python -m fonolytics.plans.runner \\
        --intentos s3://.../intentos --intentos-bkp s3://.../intentos_bkp \\
        --conclusiones s3://.../conclusiones --asignacion s3://.../asignacion \\
        --periods 202601,...,202608 --out s3://.../reports

The base profile is built once and written to the shared checkpoint
folder, from which it is removed at the end; the alert list (Query 2), the client summary (Query 3) and the
profile with alert columns (Query 4) all start from that copy.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fonolytics.config import ProfileConfig, month_labels
from fonolytics.plans.materialize import release, scratch_count
from fonolytics.plans.stages import ContactStages
from fonolytics.session import apply_sql_conf
from fonolytics.sources.sinks import write_report
from fonolytics.sources.tables import ContactTables, read_contact_tables

REPORTS = ("perfil", "alertas", "resumen", "perfil_alertas")


def run_reports(
    tables: ContactTables,
    cfg: ProfileConfig,
    out_root: str,
    fmt: str = "parquet",
    reports=REPORTS,
    first_contact_store: str | None = None,
) -> dict[str, str]:
    """Write the requested reports under ``out_root/<report>``; return their paths.

    With ``first_contact_store`` the first contacts of completed months are
    read from that store and only new months (and the target) are computed.
    """
    before = scratch_count()
    # with one report there is nothing to share
    p = ContactStages(tables, cfg, base="checkpoint" if len(reports) > 1 else "none")
    if first_contact_store:
        from fonolytics.plans.incremental import with_first_contact_store

        p = with_first_contact_store(p, first_contact_store)
    frames = {
        "perfil": lambda: p.base,                        # Query 1
        "alertas": lambda: p.d17_alerts(ordered=True),   # Query 2
        "resumen": lambda: p.d18_summary(ordered=True),  # Query 3
        "perfil_alertas": lambda: p.d22_profile_alerts,  # Query 4
    }
    out = {}
    try:
        for name in reports:
            path = f"{out_root.rstrip('/')}/{name}"
            write_report(frames[name](), path, cfg, fmt=fmt)
            out[name] = path
    finally:
        release(tables.intentos.sparkSession, before)
    return out


def explain_reports(tables: ContactTables, cfg: ProfileConfig, reports=REPORTS) -> None:
    """Print the formatted physical plans of the reports without running them.

    The base profile is not written here (that would run it), so each plan
    shows the whole path from the input scans. Only the outcome catalogue is
    read, for its size.
    """
    before = scratch_count()
    p = ContactStages(tables, cfg, base="none")
    frames = {
        "perfil": lambda: p.d12_profile,
        "alertas": lambda: p.d17_alerts(ordered=True),
        "resumen": lambda: p.d18_summary(ordered=True),
        "perfil_alertas": lambda: p.d22_profile_alerts,
    }
    try:
        for name in reports:
            print(f"== {name} ==")
            frames[name]().explain(mode="formatted")
    finally:
        release(tables.intentos.sparkSession, before)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("intentos", "intentos-bkp", "conclusiones", "asignacion", "out"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--periods", required=True, help="comma-separated periods, oldest first")
    ap.add_argument("--labels", default=None, help="month column names, same order (default: the months' names)")
    ap.add_argument("--target", default=None, help="target period (default: last)")
    ap.add_argument("--backup-min-period", type=int, default=None)
    ap.add_argument("--input-format", default="parquet")
    ap.add_argument("--input-option", action="append", default=[], metavar="KEY=VALUE", help="reader option, may be repeated")
    ap.add_argument("--snapshot-order", default=None, help="comma-separated columns that pick a client's assignment row")
    ap.add_argument("--output-format", default="parquet")
    ap.add_argument("--reports", default=",".join(REPORTS))
    ap.add_argument("--dedup", action="store_true")
    ap.add_argument("--numeric-positions", action="store_true")
    ap.add_argument("--normalise-phones", action="store_true")
    ap.add_argument("--normalise-text", action="store_true")
    ap.add_argument("--first-contact-store", default=None,
                    help="folder keeping first contacts per month between runs (recomputes missing months + target)")
    ap.add_argument("--explain", action="store_true", help="print the physical plans instead of running")
    ap.add_argument("--shuffle-partitions", type=int, default=None,
                    help="initial shuffle partitions; size for ~256 MB per partition of the attempts "
                         "after filtering, AQE coalesces small ones at run time")
    a = ap.parse_args(argv)

    periods = tuple(a.periods.split(","))
    cfg = ProfileConfig(
        periods=periods,
        labels=tuple(a.labels.split(",")) if a.labels else month_labels(periods),
        target=a.target,
        backup_min_period=a.backup_min_period if a.backup_min_period is not None else int(min(periods)),
        dedup=a.dedup,
        **({"snapshot_order": tuple(a.snapshot_order.split(","))} if a.snapshot_order else {}),
        numeric_positions=a.numeric_positions,
        normalise_phones=a.normalise_phones,
        normalise_text=a.normalise_text,
    )
    spark = apply_sql_conf(SparkSession.builder.appName("fonolytics-reports").getOrCreate())
    if a.shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.shuffle_partitions))
    paths = {"intentos": a.intentos, "intentos_bkp": a.intentos_bkp, "conclusiones": a.conclusiones, "asignacion": a.asignacion}
    tables = read_contact_tables(spark, paths, fmt=a.input_format, options=dict(o.split("=", 1) for o in a.input_option))
    if a.explain:
        explain_reports(tables, cfg, a.reports.split(","))
        return
    written = run_reports(tables, cfg, a.out, a.output_format, a.reports.split(","), a.first_contact_store)
    for name, path in written.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
