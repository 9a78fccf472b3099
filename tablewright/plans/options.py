"""Options of the profile and of the audit."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds, sizes and name patterns that results depend on.
TOP_VALUES = 10
HISTOGRAM_BINS = 20
PROXY_CORRELATION = 0.98
DEPENDENCY_PURITY = 0.99
MAX_DISTINCT_RATIO = 0.5
MAX_SEPARATION_CLASSES = 10
NEAR_DUPLICATE_DECIMALS = 3
POST_OUTCOME_PATTERNS = (
    r"^post[_-]",
    r"^resultado",
    r"^result",
    r"^outcome",
    r"[_-]after$",
    r"[_-]posterior$",
    r"^final[_-]",
    r"[_-]final$",
)


@dataclass(frozen=True)
class ProfileOptions:
    """What a profile covers. Nothing is left out unless the caller sets a limit, and then
    `Profile.truncated` says which limits left something out."""

    max_columns: int | None = None
    max_histograms: int | None = None
    max_categorical: int | None = None
    max_correlations: int | None = None
    top_k: int = TOP_VALUES
    bins: int = HISTOGRAM_BINS
    # Estimate distinct counts with sketches instead of counting them.
    approximate_distinct: bool = False


# The limits of a profile that has to fit a dashboard.
DASHBOARD = ProfileOptions(
    max_columns=200, max_histograms=50, max_categorical=60, max_correlations=25
)


@dataclass(frozen=True)
class AuditOptions:
    """From which value on a measure counts as a leak, and which columns are looked at.

    With `max_features`, the columns beyond it are named in the report as not audited.
    """

    proxy_correlation: float = PROXY_CORRELATION
    dependency_purity: float = DEPENDENCY_PURITY
    max_distinct_ratio: float = MAX_DISTINCT_RATIO
    max_features: int | None = None
    # Thresholds can only separate a target of two classes up to this many.
    max_classes: int = MAX_SEPARATION_CLASSES
    decimals: int = NEAR_DUPLICATE_DECIMALS
