"""Settings as one frozen value, read once on the driver and folded into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

# The closed vocabularies.
STATUSES = ("verified", "needs_check", "conflict", "unresolvable")
INDICATORS = ("retracted", "version_mismatch", "doi_mismatch", "duplicate_entry", "orphan", "malformed")
#: Worst first, as reviewers see them.
STATUS_ORDER = ("conflict", "needs_check", "unresolvable", "verified")
PROVIDERS = ("crossref", "openalex", "arxiv")


@dataclass(frozen=True)
class Settings:
    title_strong: float = 0.92
    title_weak: float = 0.70
    author_strong: float = 0.60
    year_tolerance: int = 1
    cache_ttl_hours: float = 72.0
    cache_schema_version: int = 1
    furniture_min_length: int = 30
    furniture_repeats: int = 3
    fallback_share: float = 0.15
    max_checks: int = 3
    # Terms that generated prose may not hold.
    banned_terms: tuple[str, ...] = (
        "fake", "fabricated", "invented", "nonexistent", "fraud", "plagiarism", "irreproducible", "not reproducible", "sloppy", "AI-generated", "AI-written",
    )


def load_settings(path: str) -> Settings:
    """Settings from a YAML file with exactly these keys; a missing or unknown key is an error."""
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    known = {f.name for f in fields(Settings)}
    if not isinstance(given, dict) or set(given) != known:
        raise ValueError(f"settings need exactly the keys {sorted(known)}")
    given["banned_terms"] = tuple(given["banned_terms"])
    return Settings(**given)
