"""The stage graph of the profile and alert jobs, built once per run.

Each stage is a ``DataFrame`` computed lazily and memoised, so a stage with
two consumers is one subtree in the plan. The alert stages are expressions
over the profile's own rows, so a single report needs no intermediate table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.config import ProfileConfig
from fonolytics.operators import alerts, assignment, attempts, profile, report
from fonolytics.plans.materialize import materialize
from fonolytics.sources.tables import ContactTables, normalise_text


class ContactStages:
    """All stages D1-D22 over one set of tables and one configuration.

    ``base`` chooses how the base profile is handed to the reports: ``none``
    keeps one plan per report, ``checkpoint`` writes it once to the shared
    checkpoint folder (for several reports of one run). ``first_contacts`` supplies D5 from
    elsewhere (the month store of ``plans.incremental``) instead of computing
    it from the attempts.
    """

    def __init__(
        self,
        tables: ContactTables,
        cfg: ProfileConfig,
        base: str = "none",
        first_contacts: DataFrame | None = None,
    ):
        if cfg.normalise_text:
            # compare like with like: the configured lists get the same lower/trim as the tables
            norm = lambda values: tuple(v.strip().lower() for v in values)
            cfg = cfg.with_(campaigns=norm(cfg.campaigns), outcome_types=norm(cfg.outcome_types), stages=norm(cfg.stages))
        self.cfg = cfg
        self.tables = normalise_text(tables) if cfg.normalise_text else tables
        self.base_mode = base
        self._first_contacts = first_contacts

    # -- attempts ---------------------------------------------------------
    @cached_property
    def effective_codes(self) -> DataFrame:
        return attempts.effective_codes(self.tables.conclusiones, self.cfg)

    @cached_property
    def keep_effective(self):
        return attempts.outcome_filter(self.tables.conclusiones, self.cfg, codes=self.effective_codes)

    @cached_property
    def keep_effective_once(self):
        return attempts.outcome_filter(self.tables.conclusiones, self.cfg, replicate=False, codes=self.effective_codes)

    @cached_property
    def d1_effective_outcomes(self) -> DataFrame:
        return attempts.effective_outcomes(self.tables.conclusiones, self.cfg)

    @cached_property
    def d2_live(self) -> DataFrame:
        return attempts.effective_attempts_live(self.tables, self.cfg, self.keep_effective)

    @cached_property
    def d3_backup(self) -> DataFrame:
        return attempts.effective_attempts_backup(self.tables, self.cfg, self.keep_effective)

    @cached_property
    def attempts_union(self) -> DataFrame:
        """D2 and D3 together, with the catalogue's copies (the attempt lists)."""
        if self.tables.registro is not None:
            return attempts.effective_attempts_tagged(self.tables.registro, self.cfg, self.keep_effective)
        return self.d2_live.unionByName(self.d3_backup)

    @cached_property
    def attempts_once(self) -> DataFrame:
        """Each effective attempt once: what first contacts and call counts read."""
        keep = self.keep_effective_once
        if self.tables.registro is not None:
            return attempts.effective_attempts_tagged(self.tables.registro, self.cfg, keep)
        return attempts.effective_attempts_live(self.tables, self.cfg, keep).unionByName(
            attempts.effective_attempts_backup(self.tables, self.cfg, keep)
        )

    @cached_property
    def d4_effective_attempts(self) -> DataFrame:
        return attempts.rank_attempts(self.attempts_union)

    @cached_property
    def d5_first_contacts(self) -> DataFrame:
        if self._first_contacts is not None:
            return self._first_contacts
        return attempts.first_contacts(self.attempts_once, by_source=not self.cfg.dedup)

    @cached_property
    def first_contacts_known(self) -> DataFrame:
        # Null client ids can never join the snapshot: drop them before the
        # aggregation so they cannot become one hot group.
        return self.d5_first_contacts.where(F.col("cu").isNotNull())

    # -- assignment -------------------------------------------------------
    @cached_property
    def d6_snapshot(self) -> DataFrame:
        return assignment.assignment_snapshot(self.tables.asignacion, self.cfg)

    @cached_property
    def d7_presence(self) -> DataFrame:
        return assignment.presence_matrix(self.tables.asignacion, self.cfg)

    @cached_property
    def d10_clean_phones(self) -> DataFrame:
        return assignment.clean_phones(self.d6_snapshot, self.cfg)

    # -- profile ----------------------------------------------------------
    @cached_property
    def d8_contacts(self) -> DataFrame:
        """D8 as the scripts compute it (a null client keeps its own row)."""
        return profile.contact_matrix(self.d5_first_contacts, self.cfg)

    @cached_property
    def d9_target_contact(self) -> DataFrame:
        return profile.target_period_contact(self.d5_first_contacts, self.cfg)

    @cached_property
    def contact_summary(self) -> DataFrame:
        """D8 + D9 for the profile, in one aggregation over known clients."""
        return profile.contact_summary(self.first_contacts_known, self.cfg)

    @cached_property
    def d11_month_status(self) -> DataFrame:
        return profile.month_status(self.d7_presence, self.d8_contacts, self.cfg)

    @cached_property
    def d12_profile(self) -> DataFrame:
        return profile.client_profile(self.d6_snapshot, self.d7_presence, self.contact_summary, self.cfg)

    def _alert_rows(self, columns: list[str] | None) -> DataFrame:
        copied = profile.client_profile(self.d6_snapshot, self.d7_presence, self.contact_summary, self.cfg, columns, alerts.COPIES)
        return alerts.row_facts(copied, self.cfg)

    @cached_property
    def base_rows(self) -> DataFrame:
        """The profile rows with their copy count, contacts and slots: what the reports start from."""
        return materialize(self._alert_rows(None), self.base_mode)

    @cached_property
    def base(self) -> DataFrame:
        """The profile (``base_final``) alone."""
        return self.base_rows.drop(alerts.COPIES, alerts.CONTACTS, alerts.SLOTS)

    @cached_property
    def facts(self) -> DataFrame:
        """The rows the alert stages read. Unless all reports share a written
        base, only the client id and the phone slots of the snapshot are carried."""
        if self.base_mode != "none":
            return self.base_rows
        return self._alert_rows(["codunicocli", *self.cfg.phone_cols])

    # -- alerts -----------------------------------------------------------
    @cached_property
    def d13_contact_phones(self) -> DataFrame:
        return alerts.contact_phones_long(self.facts, self.cfg)

    @cached_property
    def d14_assigned_phones(self) -> DataFrame:
        return alerts.assigned_phones_long(self.facts, self.cfg)

    @cached_property
    def d15_priority(self) -> DataFrame:
        return alerts.alerts_priority(self.facts)

    @cached_property
    def d16_dead(self) -> DataFrame:
        return alerts.alerts_dead_phones(self.facts)

    def d17_alerts(self, ordered: bool = True) -> DataFrame:
        return alerts.phone_alerts(self.facts, ordered=ordered)

    def d18_summary(self, ordered: bool = True) -> DataFrame:
        return alerts.alert_summary(self.d17_alerts(ordered=False), self.cfg, ordered=ordered)

    # -- report -----------------------------------------------------------
    @cached_property
    def d19_a1(self) -> DataFrame:
        return report.a1_positions(self.d15_priority, self.cfg)

    @cached_property
    def d20_a2(self) -> DataFrame:
        return report.a2_clients(self.d15_priority)

    @cached_property
    def d21_a3(self) -> DataFrame:
        return report.a3_positions(self.d16_dead, self.cfg)

    @cached_property
    def d22_profile_alerts(self) -> DataFrame:
        return report.client_profile_alerts(self.base_rows, self.cfg)
