"""Tabular data preparation on Spark: profile a table, split it, audit the split."""

from tablewright.operators.association import associations, spearman
from tablewright.operators.baseline import (
    calibration,
    classification_quality,
    linear_regression,
    logistic_regression,
)
from tablewright.operators.charts import (
    boolean_distribution,
    columns_with_gaps,
    five_numbers,
    missing_bars,
)
from tablewright.operators.features import (
    FeatureError,
    FeaturePipeline,
    Impute,
    OneHot,
    Ordinal,
    Scale,
    TargetMean,
    fit_features,
)
from tablewright.operators.leakage import audit, highest_severity
from tablewright.operators.outliers import outliers
from tablewright.operators.profile import Profile, profile
from tablewright.operators.proxies import target_proxies
from tablewright.operators.rules import (
    Between,
    Holds,
    Matches,
    NotNull,
    OneOf,
    References,
    RuleError,
    Unique,
    check_rules,
)
from tablewright.operators.similar import similar_rows
from tablewright.operators.split import (
    SPLIT_COLUMN,
    assign,
    part,
    split_counts,
    split_summary,
    write_split,
)
from tablewright.plans.options import AuditOptions, ProfileOptions
from tablewright.plans.split_plan import SplitError, SplitPlan
from tablewright.sources.catalog import Catalog
from tablewright.sources.tables import InputError, format_of, read, schema_report

__all__ = [
    "AuditOptions",
    "Between",
    "Catalog",
    "FeatureError",
    "FeaturePipeline",
    "Holds",
    "Impute",
    "InputError",
    "Matches",
    "NotNull",
    "OneHot",
    "OneOf",
    "Ordinal",
    "Profile",
    "ProfileOptions",
    "References",
    "RuleError",
    "SPLIT_COLUMN",
    "Scale",
    "SplitError",
    "SplitPlan",
    "TargetMean",
    "Unique",
    "assign",
    "associations",
    "audit",
    "boolean_distribution",
    "calibration",
    "check_rules",
    "classification_quality",
    "columns_with_gaps",
    "fit_features",
    "five_numbers",
    "format_of",
    "highest_severity",
    "linear_regression",
    "logistic_regression",
    "missing_bars",
    "outliers",
    "part",
    "profile",
    "read",
    "schema_report",
    "similar_rows",
    "spearman",
    "split_counts",
    "split_summary",
    "target_proxies",
    "write_split",
]
