"""Corpus cleaning pipeline over `documents`: one operator of `fonolytics.llm` per stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.plans.materialize import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null or no letter); profiles come from the rows with a known one."""
    from fonolytics.llm.langid import keep_known, learn_profiles

    return keep_known(docs, learn_profiles(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines whose template recurs, but for their first document; documents of which nothing is left go."""
    from fonolytics.llm.linetemplates import drop_recurring_lines

    cut = drop_recurring_lines(docs)
    cut = cut.where((F.size("dropped_lines") == 0) | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.when(F.size("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    from fonolytics.llm.dartminhash import keep_one_per_class

    return keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    from fonolytics.llm.wumanber import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in training sequences."""
    import public_tokenizers

    from fonolytics.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The models and the packing of the stages have no SQL form; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each is a table in the shared checkpoint folder."""
    base = scratch_path(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.parquet(f"{base}/{i}_{name}")
    return docs
