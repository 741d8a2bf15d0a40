"""Every parameter of the method, immutable: variants are other objects, never global state."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

# The event types of the canonical contract.
EVENT_TYPES = ("commits", "pull_requests", "commit_comments", "issue_comments", "pull_request_comments", "issue_events", "issues")
CODING = ("commits", "pull_requests")
CATEGORIES = ("non_coding", "moved", "coding")
MONTH_DAYS = 30.4375


@dataclass(frozen=True)
class Taxonomy:
    coding: tuple[str, ...]
    non_coding: tuple[str, ...]

    @property
    def active(self) -> tuple[str, ...]:
        return self.coding + self.non_coding


# Which types count on which side; types on neither are left out at the source.
TAXONOMIES = {
    "prose": Taxonomy(CODING, ("commit_comments", "issue_comments", "pull_request_comments", "issue_events")),
    "table1": Taxonomy(CODING, ("commit_comments", "issues", "issue_comments", "pull_request_comments")),
    "union": Taxonomy(CODING, ("commit_comments", "issues", "issue_comments", "pull_request_comments", "issue_events")),
}


@dataclass(frozen=True)
class Settings:
    taxonomy: str = "prose"
    inactivity_months: int = 3
    band_months: int = 3
    band_days: int = 90
    age_basis: str = "calendar_tenure"
    start: date = date(1995, 3, 31)
    end: date = date(2001, 9, 30)
    freq_months: int = 3
    min_contributors: int = 50
    min_contributors_basis: str = "active"
    min_active_devs: int = 10
    stickiness_scope: str = "project"
    pyramid_population: str = "active"
    pyramid_window_months: int = 12
    #: The number of scopes that a source must have; none: any.
    expected_scopes: int | None = None
    #: First base, second base and target (also of the types); without them the last three dates of the series.
    anchors: tuple[date, date, date] | None = None

    def __post_init__(self):
        for name, allowed in (
            ("taxonomy", tuple(TAXONOMIES)), ("age_basis", ("calendar_tenure", "accumulated_active")), ("min_contributors_basis", ("active", "cumulative")),
            ("stickiness_scope", ("project", "dataset")), ("pyramid_population", ("active", "stock")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        if self.freq_months < 3 or self.freq_months % 3:
            raise ValueError(f"freq_months must be a multiple of a quarter, not {self.freq_months}")
        if abs(self.band_days / (self.band_months * MONTH_DAYS) - 1) > 0.1:
            raise ValueError(f"band_days {self.band_days} is not within 10 % of {self.band_months} months")
        if self.start > self.end:
            raise ValueError(f"start {self.start} is after end {self.end}")

    @property
    def gap_us(self) -> int:
        return int(self.inactivity_months * MONTH_DAYS * 86_400_000_000)

    @property
    def gap_days(self) -> float:
        return self.inactivity_months * MONTH_DAYS

    @property
    def types(self) -> Taxonomy:
        return TAXONOMIES[self.taxonomy]

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


DEFAULT = Settings()
