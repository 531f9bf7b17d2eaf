"""The month store of first contacts gives the same reports as a full run."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fonolytics.config import FIXTURE_CONFIG
from fonolytics.plans.incremental import STORE_COLUMNS, mark_complete, refresh_store, settings_folder, stored_months, with_first_contact_store
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.fixtures import fixture_tables
from fonolytics.sources.tables import ContactTables


def _same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_store_from_scratch_matches_full_run(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    full = ContactStages(t, FIXTURE_CONFIG)
    store = str(tmp_path / "store")
    inc = with_first_contact_store(ContactStages(t, FIXTURE_CONFIG), store)
    assert stored_months(spark, settings_folder(store, FIXTURE_CONFIG, full.effective_codes)) == set(FIXTURE_CONFIG.periods)
    assert _same(full.d22_profile_alerts, inc.d22_profile_alerts)
    assert _same(full.d17_alerts(ordered=False), inc.d17_alerts(ordered=False))


def test_next_run_computes_only_missing_and_target_months(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    full = ContactStages(t, FIXTURE_CONFIG)
    store = str(tmp_path / "store")
    # a previous run stored every month but the last two
    old = [p for p in FIXTURE_CONFIG.periods[:-2]]
    part = settings_folder(store, FIXTURE_CONFIG, full.effective_codes)
    (full.d5_first_contacts.where(F.col("mes").isin(old)).select(*STORE_COLUMNS)
        .write.partitionBy("mes").parquet(part))
    mark_complete(spark, part, old)
    done = refresh_store(ContactStages(t, FIXTURE_CONFIG), store)
    assert done == sorted(FIXTURE_CONFIG.periods[-2:])
    # and the run after that redoes only the target month
    assert refresh_store(ContactStages(t, FIXTURE_CONFIG), store) == [FIXTURE_CONFIG.target_period]
    inc = with_first_contact_store(ContactStages(t, FIXTURE_CONFIG), store, recompute=[])
    assert _same(full.d12_profile, inc.d12_profile)


def test_runner_with_store(spark, tmp_path):
    from fonolytics.plans.runner import run_reports

    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    out = run_reports(t, FIXTURE_CONFIG, str(tmp_path / "r"), reports=("resumen",), first_contact_store=str(tmp_path / "s"))
    assert spark.read.parquet(out["resumen"]).count() == 42


def test_store_with_dedup_matches_full_dedup_run(spark, tmp_path):
    cfg = FIXTURE_CONFIG.with_(dedup=True)
    t = fixture_tables(spark, SF001, cfg)
    full = ContactStages(t, cfg)
    inc = with_first_contact_store(ContactStages(t, cfg), str(tmp_path / "store_dedup"))
    assert _same(full.d12_profile, inc.d12_profile)
    assert inc.d12_profile.count() == inc.d12_profile.select("codunicocli").distinct().count()


def test_other_settings_do_not_read_each_others_months(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    store = str(tmp_path / "store")
    refresh_store(ContactStages(t, FIXTURE_CONFIG), store)
    one = FIXTURE_CONFIG.with_(campaigns=FIXTURE_CONFIG.campaigns[:1])
    inc = with_first_contact_store(ContactStages(t, one), store)
    assert _same(ContactStages(t, one).d12_profile, inc.d12_profile)


def test_a_recomputed_month_without_contacts_is_emptied(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    store = str(tmp_path / "store")
    refresh_store(ContactStages(t, FIXTURE_CONFIG), store)
    less = type(t)(*(d.where(F.col("periodo") != FIXTURE_CONFIG.target_period) for d in (t.intentos, t.intentos_bkp)), t.conclusiones, t.asignacion)
    inc = with_first_contact_store(ContactStages(less, FIXTURE_CONFIG), store)
    assert _same(ContactStages(less, FIXTURE_CONFIG).d12_profile, inc.d12_profile)


def test_a_code_added_to_the_catalogue_uses_another_part_of_the_store(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    fewer = ContactTables(t.intentos, t.intentos_bkp, t.conclusiones.where("conlusion_cloud <> 'R-F'"), t.asignacion)
    store = str(tmp_path / "store")
    assert _same(with_first_contact_store(ContactStages(fewer, FIXTURE_CONFIG), store).d12_profile, ContactStages(fewer, FIXTURE_CONFIG).d12_profile)
    full = ContactStages(t, FIXTURE_CONFIG)
    assert not _same(full.d12_profile, ContactStages(fewer, FIXTURE_CONFIG).d12_profile)
    assert _same(with_first_contact_store(ContactStages(t, FIXTURE_CONFIG), store).d12_profile, full.d12_profile)
    # and back: the first part is still complete
    assert refresh_store(ContactStages(fewer, FIXTURE_CONFIG), store, recompute=[]) == []


def test_a_run_that_breaks_off_leaves_its_months_incomplete(spark, tmp_path, monkeypatch):
    from fonolytics.plans import incremental

    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    full, store = ContactStages(t, FIXTURE_CONFIG), str(tmp_path / "store")
    part = settings_folder(store, FIXTURE_CONFIG, full.effective_codes)

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "mark_complete", lost)
    with pytest.raises(RuntimeError):
        refresh_store(full, store)
    monkeypatch.undo()
    # half of a month is there without a mark, as after a commit that broke off
    assert stored_months(spark, part) == set()
    inc = with_first_contact_store(ContactStages(t, FIXTURE_CONFIG), store, recompute=[])
    assert _same(full.d12_profile, inc.d12_profile)


def test_months_without_contacts_are_not_counted_again(spark, tmp_path):
    t = fixture_tables(spark, SF001, FIXTURE_CONFIG)
    empty = ContactTables(t.intentos.limit(0), t.intentos_bkp.limit(0), t.conclusiones, t.asignacion)
    store = str(tmp_path / "store")
    assert refresh_store(ContactStages(empty, FIXTURE_CONFIG), store) == sorted(FIXTURE_CONFIG.periods)
    assert refresh_store(ContactStages(empty, FIXTURE_CONFIG), store, recompute=[]) == []
    inc = with_first_contact_store(ContactStages(empty, FIXTURE_CONFIG), store, recompute=[])
    assert inc.d5_first_contacts.count() == 0 and inc.d12_profile.count() == 52
