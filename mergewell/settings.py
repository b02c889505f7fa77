"""Settings of a run, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    default_country: str = "IN"
    skill_fuzzy_threshold: float = 82.0
    country_fuzzy_threshold: float = 85.0
    corroboration_bonus: str = "0.05"
    corroboration_cap: str = "1.2"
    pdf_max_pages: int = 20
    #: Records of one source that an entity keeps; None keeps all, as a merge of given records does.
    records_per_source: int | None = None
    version: str = "1.0.0"
    #: ISO time taken as now; None is the time of the run, read once.
    now: str | None = None
