"""Skew probe: put a third of all attempts into one (client, month) group and
compare how the stages spread it over tasks, from Spark's event log.

    python tools/skew_probe.py [sf_dir]

Derived from the supplied tables (the fixture attempts, remapped); prints,
per variant, the wall time and the most shuffle records any single task read.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fonolytics.config import FIXTURE_CONFIG  # noqa: E402
from fonolytics.plans.materialize import ensure_checkpoint_dir  # noqa: E402
from fonolytics.plans.stages import ContactStages  # noqa: E402
from fonolytics.session import SQL_CONF  # noqa: E402
from fonolytics.sources.fixtures import fixture_tables  # noqa: E402
from fonolytics.sources.tables import ContactTables  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="skew-probe-")
    b = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("PROBE_PARTITIONS", "64"))
         .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", scratch).config("spark.driver.memory", "16g"))
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    # keep every shuffle partition a task of its own, so the per-task counts show the spread
    b = b.config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, os.path.join(scratch, "ckpt"))

    t = fixture_tables(spark, sf_dir, FIXTURE_CONFIG)
    hot = (F.col("id_intento") % 3 == 0)

    def skew(df):
        # a third of the attempts become effective calls of client 7 in the target month
        return df.withColumns({
            "contact_id": F.when(hot, F.lit(7)).otherwise(F.col("contact_id")),
            "periodo": F.when(hot, F.lit("200002")).otherwise(F.col("periodo")),
            "wrap_up": F.when(hot, F.lit("R-F")).otherwise(F.col("wrap_up")),
            "campaign_name": F.when(hot, F.lit("cob_bpe_00")).otherwise(F.col("campaign_name")),
        })

    st = ContactTables(skew(t.intentos), t.intentos_bkp, t.conclusiones, t.asignacion)
    p = ContactStages(st, FIXTURE_CONFIG, base="none")
    keys = ["fuente", "cu", "mes"]
    order = ["fecha_key", "id_intento", "dnis", "wrap_up"]
    variants = {
        "d5_min_struct": lambda: p.d5_first_contacts,
        "d5_window_filter": lambda: p.attempts_union.withColumn(
            "o", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("o = 1"),
        "d4_range_numbering": lambda: p.d4_effective_attempts,
        "d4_window": lambda: p.attempts_union.withColumn(
            "orden", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))),
    }
    total = p.attempts_union.count()
    hot_rows = p.attempts_union.where((F.col("cu") == 7) & (F.col("mes") == "200002")).count()
    marks = {}
    for name, build in variants.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.time()
        build().write.format("noop").mode("overwrite").save()
        marks[name] = round(time.time() - t0, 2)
    spark.stop()

    group_of_job, stage_group, max_read = {}, {}, {}
    for fn in glob.glob(os.path.join(scratch, "eventlog_v2_*", "events_*")):
        raw = zstandard.ZstdDecompressor().stream_reader(open(fn, "rb")).read().decode()
        for line in raw.splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                for s in e["Stage IDs"]:
                    stage_group[s] = g
            elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                g = stage_group.get(e["Stage ID"])
                n = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
                if g:
                    max_read[g] = max(max_read.get(g, 0), n)
    print(json.dumps({"effective_attempts": total, "hot_group_rows": hot_rows,
                      "variants": {k: {"sec": marks[k], "max_task_shuffle_records": max_read.get(k, 0)} for k in variants}}))


if __name__ == "__main__":
    main()
