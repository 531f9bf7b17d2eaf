"""The streaming first-contact job: incremental batches, replay-safe change log."""

import pyspark.sql.functions as F
from pyspark.sql import Row

from fonolytics.operators.attempts import outcome_filter
from fonolytics.sources.tables import ATTEMPT_SCHEMA
from fonolytics.streaming.first_contact import (
    effective_attempt_stream,
    first_contact_updates,
    read_first_contacts,
    start_changelog_sink,
)
from helpers import CFG, OUTCOMES, attempt, ts

P = "51900000001"


import os

import pytest


@pytest.mark.parametrize("watermark", [None, "31 days"])
def test_late_earlier_call_improves_first_contact(spark, tmp_path, watermark):
    src_live, src_bkp = tmp_path / "live", tmp_path / "bkp"
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([attempt("202603", 1, "CE", "51900000002", ts(5), 2)], ATTEMPT_SCHEMA).write.parquet(str(src_live / "b1"))
    spark.createDataFrame([], ATTEMPT_SCHEMA).write.parquet(str(src_bkp / "b1"))
    keep = outcome_filter(spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string"), CFG)

    def run():
        live = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(src_live / "*"))
        bkp = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(src_bkp / "*"))
        q = start_changelog_sink(first_contact_updates(effective_attempt_stream(live, bkp, keep, CFG), watermark), out, state)
        q.awaitTermination()

    run()
    assert [(r.cu, r.telefono) for r in read_first_contacts(spark, out).collect()] == [(1, "900000002")]
    # a later file holds an earlier call, plus a non-effective one
    spark.createDataFrame([attempt("202603", 1, "CE", "51900000001", ts(1), 1),
                           attempt("202603", 1, "NC", "51900000009", ts(1), 0)], ATTEMPT_SCHEMA
                          ).write.parquet(str(src_live / "b2"))
    run()
    got = read_first_contacts(spark, out)
    assert [(r.fuente, r.cu, r.telefono, r.orden) for r in got.collect()] == [("live", 1, "900000001", 1)]
    # the log holds one row per improvement, and re-reading it is idempotent
    assert spark.read.parquet(out + "/log").count() == 2
    assert got.select(F.count("*")).first()[0] == 1


def test_watermark_evicts_closed_days(spark, tmp_path):
    import datetime as dt

    src, empty = tmp_path / "live", tmp_path / "bkp"
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([], ATTEMPT_SCHEMA).write.parquet(str(empty / "b0"))
    keep = outcome_filter(spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string"), CFG)

    def run(batch, rows):
        spark.createDataFrame(rows, ATTEMPT_SCHEMA).write.parquet(str(src / batch))
        live = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(src / "*"))
        bkp = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(empty / "*"))
        q = start_changelog_sink(first_contact_updates(effective_attempt_stream(live, bkp, keep, CFG), "31 days"), out, state)
        q.awaitTermination()
        return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    run("b1", [attempt("202601", 1, "CE", P, dt.datetime(2026, 1, 1, 9))])
    run("b2", [attempt("202603", 2, "CE", P, dt.datetime(2026, 3, 15, 9))])
    assert run("b3", [attempt("202603", 3, "CE", P, dt.datetime(2026, 3, 16, 9))]) == 2  # January's day left the state once the watermark passed it
    got = {r.cu: r.telefono for r in read_first_contacts(spark, out).collect()}
    assert got == {1: "900000001", 2: "900000001", 3: "900000001"}


def test_stream_from_attempt_folders_matches_batch(spark, tmp_path):
    from conftest import SF001
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.plans.stages import ContactStages
    from fonolytics.sources.fixtures import fixture_tables
    from fonolytics.streaming.first_contact import start_first_contact_stream

    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    t.intentos.write.parquet(str(tmp_path / "live"))
    t.intentos_bkp.write.parquet(str(tmp_path / "bkp"))
    q = start_first_contact_stream(spark, str(tmp_path / "live"), str(tmp_path / "bkp"), t.conclusiones, FIXTURE_CONFIG,
                                   str(tmp_path / "log"), str(tmp_path / "state"), available_now=True)
    q.awaitTermination()
    got = read_first_contacts(spark, str(tmp_path / "log"))
    want = ContactStages(t, FIXTURE_CONFIG).d5_first_contacts
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_many_files_and_batches_lose_nothing(spark, tmp_path):
    """Line items in several files, in no order of time, one file per micro-batch: equal to the batch stage."""
    import os

    from conftest import SF001
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.plans.catalog import all_queries
    from fonolytics.streaming.first_contact import run_fixture_stream

    for name in os.listdir(SF001):
        if not name.startswith("lineitem"):
            os.symlink(f"{SF001}/{name}", tmp_path / name)
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    lines.repartition(5, "l_linenumber", "l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = run_fixture_stream(spark, str(tmp_path), FIXTURE_CONFIG)
    want = all_queries()["first_contact_per_period"](spark, SF001)
    assert want.count() > 500 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_opt_in_watermark_reports_what_it_drops(spark, tmp_path):
    import datetime as dt

    from fonolytics.streaming.first_contact import dropped_rows

    src, empty, out, state = tmp_path / "live", tmp_path / "bkp", str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([], ATTEMPT_SCHEMA).write.parquet(str(empty / "b0"))
    keep = outcome_filter(spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string"), CFG)
    dropped = []
    for name, day in (("b1", dt.datetime(2026, 3, 15, 9)), ("b2", dt.datetime(2026, 3, 16, 9)), ("b3", dt.datetime(2026, 1, 1, 9))):
        spark.createDataFrame([attempt(f"{day:%Y%m}", 1, "CE", P, day)], ATTEMPT_SCHEMA).write.parquet(str(src / name))
        live = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(src / "*"))
        bkp = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(empty / "*"))
        q = start_changelog_sink(first_contact_updates(effective_attempt_stream(live, bkp, keep, CFG), "1 day"), out, state)
        q.awaitTermination()
        dropped.append(dropped_rows(q))
    assert dropped == [0, 0, 1]
    assert {r.mes for r in read_first_contacts(spark, out).collect()} == {"202603"}


def test_compaction_keeps_the_result_and_later_improvements(spark, tmp_path):
    from fonolytics.streaming.first_contact import compact

    src, empty, out, state = tmp_path / "live", tmp_path / "bkp", str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([], ATTEMPT_SCHEMA).write.parquet(str(empty / "b0"))
    keep = outcome_filter(spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string"), CFG)
    for i, (phone, day) in enumerate((("51900000003", 9), ("51900000002", 5), ("51900000001", 1))):
        spark.createDataFrame([attempt("202603", 1, "CE", phone, ts(day), i)], ATTEMPT_SCHEMA).write.parquet(str(src / f"b{i}"))
        live = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(src / "*"))
        bkp = spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(empty / "*"))
        start_changelog_sink(first_contact_updates(effective_attempt_stream(live, bkp, keep, CFG)), out, state).awaitTermination()
        before = read_first_contacts(spark, out).collect()
        compact(spark, out)
        assert read_first_contacts(spark, out).collect() == before and before[0].telefono == phone[-9:]
        assert not [n for n in os.listdir(out + "/log") if n.startswith("part-")]
    assert sorted(n for n in os.listdir(out) if not n.startswith(".")) == ["complete-00000003", "log", "version-00000003"]


def _log_of(spark, out, rows):
    from fonolytics.streaming.first_contact import GROUP_KEYS, log_schema

    spark.createDataFrame([("live", cu, "202603", (ts(day), 1, phone, "CE", phone)) for cu, day, phone in rows], log_schema(GROUP_KEYS)).write.mode("append").parquet(out + "/log")


def test_reading_before_the_first_improvement_is_empty(spark, tmp_path):
    from fonolytics.streaming.first_contact import compact, start_first_contact_stream

    assert read_first_contacts(spark, str(tmp_path / "nothing")).collect() == []
    for n in ("live", "bkp"):
        spark.createDataFrame([], ATTEMPT_SCHEMA).write.parquet(str(tmp_path / n))
    codes = spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string")
    out = str(tmp_path / "log")
    start_first_contact_stream(spark, str(tmp_path / "live"), str(tmp_path / "bkp"), codes, CFG, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    compact(spark, out)
    assert read_first_contacts(spark, out).collect() == []


@pytest.mark.parametrize("step", ["create", "delete"])
def test_compaction_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, step):
    """A crash before the pointer, or between any two removals, leaves a readable log with the same result."""
    from fonolytics.streaming import first_contact as fc

    out = str(tmp_path / "log")
    _log_of(spark, out, [(1, 5, "b"), (2, 5, "c")])
    fc.compact(spark, out)
    _log_of(spark, out, [(1, 2, "a")])
    want = sorted(read_first_contacts(spark, out).collect())
    real, calls = fc._paths, []

    def breaking(*args):
        fs, path = real(*args)

        class Fs:
            def __getattr__(self, name):
                if name == step:
                    if len(calls) >= (0 if step == "create" else 1):
                        raise RuntimeError("lost")
                    calls.append(name)
                return getattr(fs, name)

        return Fs(), path

    monkeypatch.setattr(fc, "_paths", breaking)
    with pytest.raises(RuntimeError):
        fc.compact(spark, out)
    monkeypatch.undo()
    assert sorted(read_first_contacts(spark, out).collect()) == want
    fc.compact(spark, out)
    assert sorted(read_first_contacts(spark, out).collect()) == want


def test_state_stream_sees_a_code_that_is_added_midway(spark, tmp_path):
    """Several files, one batch each; the catalogue gains a code between them: equal to the batch stage each time."""
    from fonolytics.plans.stages import ContactStages
    from fonolytics.streaming.contact_state import contacts_now, start_contact_state_stream
    from helpers import tables

    batches = [
        [attempt("202603", 1, "CE", "51900000002", ts(5), 2), attempt("202603", 1, "NEW", "51900000003", ts(3), 3), attempt("202603", None, "CE", None, ts(9), 9)],
        [attempt("202603", 1, "CE", "51900000004", ts(4), 4), attempt("202602", 1, "NEW", "51900000005", None, 5), attempt("202603", 2, None, "51900000006", ts(1), 6)],
        [attempt("202603", 1, "NEW", "51900000001", ts(2), 1), attempt("202603", 2, "PDP", "51900000007", ts(8), 7, campaign="other")],
    ]
    more = [*OUTCOMES, ("NEW", "pdp")]
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPT_SCHEMA).write.parquet(str(tmp_path / "live" / f"b{i}"))
        spark.createDataFrame(rows[:1], ATTEMPT_SCHEMA).write.parquet(str(tmp_path / "bkp" / f"b{i}"))
        read = lambda n: spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(tmp_path / n / "*"))
        start_contact_state_stream(read("live"), read("bkp"), CFG, out, state, available_now=True).awaitTermination()
        seen += rows
        for codes in (OUTCOMES, more):
            t = tables(spark, live=seen, bkp=[b[0] for b in batches[: i + 1]], outcomes=codes)
            want = ContactStages(t, CFG).d5_first_contacts
            got = contacts_now(spark, out, t.conclusiones, CFG)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, (i, codes)
    assert want.count() >= 4


def test_state_stream_over_the_test_tables(spark, tmp_path):
    from conftest import SF001
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.plans.catalog import all_queries
    from fonolytics.streaming.contact_state import run_fixture_state_stream

    for name in os.listdir(SF001):
        if not name.startswith("lineitem"):
            os.symlink(f"{SF001}/{name}", tmp_path / name)
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    lines.repartition(2, "l_linenumber", "l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = run_fixture_state_stream(spark, str(tmp_path), FIXTURE_CONFIG)
    want = all_queries()["first_contact_per_period"](spark, SF001)
    assert want.count() > 500 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_idle_groups_are_closed_and_open_again():
    """The state of a group with a timer, driven by hand: a call that comes after the group was closed is emitted again."""
    from types import SimpleNamespace as Obj

    from fonolytics.streaming.contact_state import FirstAttemptPerCode

    kept, timers = {}, []
    state = Obj(containsKey=lambda k: k in kept, getValue=lambda k: kept[k], updateValue=kept.__setitem__, clear=kept.clear)
    handle = Obj(getMapState=lambda *a: state, listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    clock = lambda ms: Obj(getCurrentProcessingTimeInMs=lambda: ms)
    call = lambda t: Row(wrap_up="CE", fecha_key=t, id_intento=None, dnis=None, telefono=f"p{t}")
    p = FirstAttemptPerCode(2.0)
    p.init(handle)
    run = lambda t, ms: [r.telefono for r in p.handleInputRows(("live", 1, "202603"), iter([call(t)]), clock(ms))]
    assert run(5, 0) == ["p5"] and run(6, 1000) == [] and run(4, 1500) == ["p4"]
    assert timers == [3500] and len(kept) == 1
    assert list(p.handleExpiredTimer(("live", 1, "202603"), clock(3500), None)) == [] and not kept
    assert run(9, 4000) == ["p9"]  # the log already has p4, whose minimum decides


def test_timers_need_a_running_query(spark, tmp_path):
    from fonolytics.streaming.contact_state import start_contact_state_stream

    with pytest.raises(ValueError):
        start_contact_state_stream(None, None, CFG, str(tmp_path), str(tmp_path), available_now=True, idle_seconds=1.0)


def test_micro_batches_do_not_grow_with_files_and_join_nothing(spark, tmp_path):
    """Many small files of line items come in a few micro-batches, whose plans read attempts only."""
    from conftest import SF001
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.plans.catalog import all_queries
    from fonolytics.sources.fixtures import outcome_catalogue
    from fonolytics.streaming.contact_state import contacts_now, first_attempt_updates, attempt_log_stream
    from fonolytics.streaming.contact_state import CODE_KEYS
    from fonolytics.streaming.first_contact import DELIVERIES, fixture_logs

    os.symlink(f"{SF001}/orders.parquet", tmp_path / "orders.parquet")
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    lines.repartition(12, "l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    updates = first_attempt_updates(attempt_log_stream(*fixture_logs(spark, str(tmp_path)), FIXTURE_CONFIG))
    plan = updates._jdf.queryExecution().logical().toString()
    assert "Join" not in plan and "TransformWithState" not in plan, plan
    out = str(tmp_path / "log")
    query = start_changelog_sink(updates, out, str(tmp_path / "state"), keys=CODE_KEYS)
    query.awaitTermination()
    assert 2 <= sum(p["numInputRows"] > 0 for p in query.recentProgress) <= 2 * DELIVERIES
    got, want = contacts_now(spark, out, outcome_catalogue(spark, SF001), FIXTURE_CONFIG), all_queries()["first_contact_per_period"](spark, SF001)
    assert want.count() > 500 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_log_without_attempts(spark, tmp_path):
    """All calls are of the backup's months, or no order matches: the live log, then both, are empty folders."""
    from conftest import SF001
    from fonolytics.config import FIXTURE_CONFIG
    from fonolytics.streaming.contact_state import run_fixture_state_stream

    lines, orders = (spark.read.parquet(f"{SF001}/{n}.parquet") for n in ("lineitem", "orders"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.where("year(o_orderdate) = 1997").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r.fuente for r in run_fixture_state_stream(spark, str(tmp_path), FIXTURE_CONFIG).select("fuente").distinct().collect()} == {"bkp"}
    orders.limit(0).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert run_fixture_state_stream(spark, str(tmp_path), FIXTURE_CONFIG).count() == 0


def test_streams_with_and_without_timers_agree(spark, tmp_path):
    """With timers a query has no end of its own: it is stopped once its log is as the other one's, or time is up."""
    import time

    from fonolytics.streaming.contact_state import contacts_now, start_contact_state_stream

    rows = [
        attempt("202603", 1, "CE", "51900000002", ts(5), 2), attempt("202603", 1, "CE", "51900000001", ts(5), None),
        attempt("202603", None, "CE", None, ts(9), 9), attempt("202603", 1, "PDP", "51900000004", ts(4), 4),
        attempt("202602", 2, None, "51900000006", None, 6), attempt("202603", 2, "CE", "51900000007", None, 7),
    ]
    for n in ("live", "bkp"):
        spark.createDataFrame(rows, ATTEMPT_SCHEMA).write.parquet(str(tmp_path / n))
    read = lambda n: spark.readStream.schema(ATTEMPT_SCHEMA).parquet(str(tmp_path / n))
    codes = spark.createDataFrame(OUTCOMES, "conlusion_cloud string, tipo_resultado string")
    now = lambda out: sorted(contacts_now(spark, str(tmp_path / out), codes, CFG).collect(), key=str)
    start = lambda out, **how: start_contact_state_stream(read("live"), read("bkp"), CFG, str(tmp_path / out), str(tmp_path / f"state-{out}"), **how)
    start("plain", available_now=True).awaitTermination()
    want = now("plain")
    query, end = start("timed", idle_seconds=3600.0), time.monotonic() + 60
    try:
        while (got := now("timed")) != want and query.isActive and time.monotonic() < end:
            time.sleep(1)
    finally:
        query.stop()
    assert len(want) >= 3 and got == want
