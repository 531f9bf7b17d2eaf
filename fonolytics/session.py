"""Spark session for local runs, tests and the benchmark.

On a cluster the session comes from the platform; only the SQL settings in
``SQL_CONF`` matter to the jobs and can be applied to any session.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the jobs are planned for: adaptive execution (runtime coalescing,
# skew-join splitting, broadcast conversion behind a measured size), UTC
# timestamps, and distributed numbering without per-row Python.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_sql_conf(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fonolytics") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FONO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # delete checkpoint files once their DataFrames are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
