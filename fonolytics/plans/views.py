"""Expose the stages as temporary views for ad-hoc SQL.

Analysts used to writing SQL against the stages can query them by name with
``spark.sql``; the views are the same lazy plans as the Python stages.
"""

from __future__ import annotations

from fonolytics.plans.stages import ContactStages

VIEW_STAGES = {
    "effective_attempts": lambda p: p.d4_effective_attempts,
    "first_contact_per_period": lambda p: p.d5_first_contacts,
    "assignment_snapshot": lambda p: p.d6_snapshot,
    "presence_matrix": lambda p: p.d7_presence,
    "contact_matrix": lambda p: p.d8_contacts,
    "target_period_contact": lambda p: p.d9_target_contact,
    "client_profile": lambda p: p.base,
    "contact_phones_long": lambda p: p.d13_contact_phones,
    "assigned_phones_long": lambda p: p.d14_assigned_phones,
    "alerts_priority": lambda p: p.d15_priority,
    "alerts_dead_phones": lambda p: p.d16_dead,
    "phone_alerts": lambda p: p.d17_alerts(ordered=False),
    "alert_summary": lambda p: p.d18_summary(ordered=False),
    "client_profile_alerts": lambda p: p.d22_profile_alerts,
}


def register_views(job: ContactStages, prefix: str = "", stages=None) -> list[str]:
    """Create or replace ``<prefix><stage>`` temp views; return their names.

    ``effective_attempts`` numbers every attempt (a checkpointed job), so it
    is only registered when asked for in ``stages``.
    """
    wanted = stages or [s for s in VIEW_STAGES if s != "effective_attempts"]
    names = []
    for stage in wanted:
        name = f"{prefix}{stage}"
        VIEW_STAGES[stage](job).createOrReplaceTempView(name)
        names.append(name)
    return names
