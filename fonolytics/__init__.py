"""Contact-history and phone-quality analytics on Spark DataFrames."""

from fonolytics.config import FIXTURE_CONFIG, ProfileConfig
from fonolytics.plans.stages import ContactStages
from fonolytics.sources.tables import ContactTables, read_contact_tables

__all__ = ["ContactStages", "ContactTables", "FIXTURE_CONFIG", "ProfileConfig", "read_contact_tables"]
