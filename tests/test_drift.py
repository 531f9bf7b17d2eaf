"""Monthly files with drifting columns become one table with stable names and types."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from fonolytics.config import FIXTURE_CONFIG as CFG
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.drift import common_type, merged_schema, read_months, stable_name
from fonolytics.sources.fixtures import fixture_tables
from fonolytics.sources.tables import ContactTables


def _write(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(str(path))
    return str(path)


def test_columns_that_appear_widen_and_vanish(spark, tmp_path):
    paths = {
        "202602": _write(spark, tmp_path / "b", [(3_000_000_000, 1.5, "x", "A-1")], "CodUniCli long, saldo double, `Tipo de Canal` string, estudio string"),
        "202601": _write(spark, tmp_path / "a", [(7, 2, 100)], "codunicli int, saldo int, estudio int"),
        "202603": _write(spark, tmp_path / "c", [], "codunicli int, nuevo date"),
    }
    got = read_months(spark, paths)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("codunicli", "bigint"), ("saldo", "double"), ("estudio", "string"), ("codmes", "string"), ("tipo_de_canal", "string"), ("nuevo", "date")]
    assert sorted(map(tuple, got.collect())) == [(7, 2.0, "100", "202601", None, None), (3_000_000_000, 1.5, "A-1", "202602", "x", None)]
    plan = got.where("codmes = '202601'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1  # the other months' files stay unread


def test_types_keep_every_value():
    t = T
    cases = [
        (t.IntegerType(), t.LongType(), t.LongType()), (t.LongType(), t.DoubleType(), t.StringType()), (t.IntegerType(), t.FloatType(), t.DoubleType()),
        (t.DecimalType(10, 2), t.IntegerType(), t.DecimalType(12, 2)), (t.DecimalType(38, 10), t.LongType(), t.DecimalType(38, 10)),
        (t.DecimalType(38, 30), t.LongType(), t.StringType()), (t.DateType(), t.TimestampType(), t.TimestampType()),
        (t.StringType(), t.LongType(), t.StringType()), (t.BooleanType(), t.LongType(), t.StringType()), (t.NullType(), t.DateType(), t.DateType()),
    ]
    for a, b, want in cases:
        assert common_type(a, b) == common_type(b, a) == want, (a, b)


def test_names_that_meet_are_an_error():
    assert stable_name(" Tipo  de-Canal ") == "tipo_de_canal" and stable_name("contact id") == "contact_id"
    with pytest.raises(ValueError):
        merged_schema([T.StructType([T.StructField("a b", T.LongType()), T.StructField("A_B", T.LongType())])])


def test_profile_over_drifting_months(spark, tmp_path):
    """The assignment split into months, with phones as text in one and an extra column in another: the same profile, plus that column."""
    t = fixture_tables(spark, SF001, CFG)
    paths = {}
    for i, (month,) in enumerate(sorted(t.asignacion.select("codmes").distinct().collect())):
        part = t.asignacion.where(F.col("codmes") == month).drop("codmes")
        if i == 2:
            part = part.withColumns({c: F.col(c).cast("string") for c in CFG.phone_cols})
        if month == CFG.target_period:
            part = part.withColumn("Estudio Externo", F.lit("e1"))
        paths[month] = str(tmp_path / month)
        part.write.parquet(paths[month])
    drifted = read_months(spark, paths)
    assert drifted.count() == t.asignacion.count()
    got = ContactStages(ContactTables(t.intentos, t.intentos_bkp, t.conclusiones, drifted), CFG).d22_profile_alerts
    want = ContactStages(t, CFG).d22_profile_alerts
    assert set(got.columns) - set(want.columns) == {"estudio_externo"} and {r.estudio_externo for r in got.collect()} == {"e1"}
    text = [F.col(c).cast("string").alias(c) for c in want.columns]
    assert got.select(*text).exceptAll(want.select(*text)).count() == 0 and got.count() == want.count()
