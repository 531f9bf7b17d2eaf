"""Parameters of the contact-profile and phone-alert jobs.

Every constant the original scripts hard-code (periods, month labels, target
month, campaign list, outcome types, stages, phone slots, alert names and
severity order) lives here, so one frozen object drives both the Spark stages
and the generated oracle SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These must equal the business definitions of the scripts.
# Outcome types that count as an effective contact.
EFFECTIVE_OUTCOME_TYPES = ("pdp", "pdp - fdp", "contacto - efectivo")
# Campaigns whose attempts are considered.
CAMPAIGNS = ("cob_bpe_00", "cob_bpe_01", "cob_bpe_02")
# Delinquency stages kept in the assignment.
STAGES = ("temprana", "intermedia", "tardia")
# Month cell values and target-month summary labels.
LABEL_CONTACTED = "ce"
LABEL_NOT_CONTACTED = "nc"
LABEL_TARGET_CONTACT = "contacto"
LABEL_TARGET_NO_CONTACT = "sin contacto"
# Alert names, in the severity order used by the client summary
# (1 = most severe): not assigned, badly ranked, never effective.
ALERT_OK = "ok"
ALERT_A1 = "A1_SCORE_MAL_PRIORIZADO"
ALERT_A2 = "A2_TELEFONO_NO_ASIGNADO"
ALERT_A3 = "A3_TELEFONO_SIN_CONTACTO"
SEVERITY_ORDER = (ALERT_A2, ALERT_A1, ALERT_A3)
# Flags of the client summary and the profile-with-alerts report.
FLAG_YES = "SI"
FLAG_NO = "NO"
POSITIONS_PREFIX = "SI - pos "
# Month labels of the eight-month window, in order.
MONTH_LABELS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto")
# Names of all months, for other windows.
MONTH_NAMES = (*MONTH_LABELS, "septiembre", "octubre", "noviembre", "diciembre")
# Periods of the original window.
PERIODS = ("202601", "202602", "202603", "202604", "202605", "202606", "202607", "202608")
# Digits of the dialled number that identify a phone.
PHONE_DIGITS = 9
# Value that marks an empty phone slot.
EMPTY_PHONE = "0"
# ---------------------------------------------------------------------------

# Source tags for the two attempt tables (ours; the scripts number each union
# arm separately, so the tag keeps that partitioning explicit).
SOURCE_LIVE = "live"
SOURCE_BACKUP = "bkp"


def month_labels(periods: tuple[str, ...]) -> tuple[str, ...]:
    """The month's name per ``yyyyMM`` period, with the year where a name occurs twice; other periods name themselves."""
    names = [MONTH_NAMES[int(p[4:]) - 1] if len(p) == 6 and p.isdigit() and 1 <= int(p[4:]) <= 12 else f"m{p}" for p in periods]
    return tuple(n if names.count(n) == 1 else f"{n}_{p[:4]}" for n, p in zip(names, periods))


@dataclass(frozen=True)
class ProfileConfig:
    """One run of the profile / alert jobs.

    ``periods`` are ``yyyyMM``-like strings compared as strings (the scripts
    use string BETWEEN); ``labels`` name the month columns in the same order.
    The last period is the target month unless ``target`` says otherwise.
    """

    periods: tuple[str, ...] = PERIODS
    labels: tuple[str, ...] = MONTH_LABELS
    target: str | None = None
    backup_min_period: int = 202601
    campaigns: tuple[str, ...] = CAMPAIGNS
    outcome_types: tuple[str, ...] = EFFECTIVE_OUTCOME_TYPES
    stages: tuple[str, ...] = STAGES
    n_phones: int = 10
    phone_digits: int = PHONE_DIGITS
    severity: tuple[str, ...] = SEVERITY_ORDER
    # Options that deviate from the scripts on purpose (all off = faithful).
    dedup: bool = False               # one profile row per client (S2)
    numeric_positions: bool = False   # "1,2,10" instead of "1,10,2" (S17)
    normalise_phones: bool = False    # last digits on assigned phones too (S15)
    normalise_text: bool = False      # lower/trim codes, campaigns, stages (S24)
    # Which row the snapshot takes of a client assigned twice in the target
    # month; columns that the table lacks are passed over.
    snapshot_order: tuple[str, ...] = ("id_asignacion",)

    def __post_init__(self):
        if len(self.periods) != len(self.labels):
            raise ValueError("periods and labels must have the same length")
        if len(set(self.periods)) != len(self.periods):
            raise ValueError("periods must be distinct")
        if self.target is not None and self.target not in self.periods:
            raise ValueError("target must be one of the periods")
        if self.n_phones < 1:
            raise ValueError("n_phones must be >= 1")
        if sorted(self.severity) != sorted(SEVERITY_ORDER):
            raise ValueError(f"severity must order exactly {SEVERITY_ORDER}")

    @property
    def target_period(self) -> str:
        return self.target if self.target is not None else self.periods[-1]

    @property
    def target_label(self) -> str:
        return self.labels[self.periods.index(self.target_period)]

    @property
    def period_lo(self) -> str:
        return min(self.periods)

    @property
    def period_hi(self) -> str:
        return max(self.periods)

    @property
    def months(self) -> list[tuple[str, str]]:
        """(period, label) pairs in configured order."""
        return list(zip(self.periods, self.labels))

    @property
    def phone_cols(self) -> list[str]:
        return [f"telefono{k}" for k in range(1, self.n_phones + 1)]

    @property
    def clean_cols(self) -> list[str]:
        return [f"tlf{k}_limpio" for k in range(1, self.n_phones + 1)]

    @property
    def summary_col(self) -> str:
        return f"resultado_{self.target_label}_resumen"

    @property
    def target_result_col(self) -> str:
        return f"resultado_{self.target_label}"

    def severity_rank(self, alert: str) -> int:
        return self.severity.index(alert) + 1

    def with_(self, **kw) -> "ProfileConfig":
        return replace(self, **kw)


# The eight half-year periods that play the eight months on the test tables
# (year * 100 + half), target = last one; see FIXTURES.md.
FIXTURE_CONFIG = ProfileConfig(
    periods=("199701", "199702", "199801", "199802", "199901", "199902", "200001", "200002"),
    backup_min_period=199701,
)
