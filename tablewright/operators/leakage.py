"""Audit of a split: does the training part hold what it must not know?

Measuring and judging are apart. `audit` measures everything in a few jobs; `VERDICTS` says, for
each check, which measurements are how severe and in which words. The first rule that holds decides.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.kinds import is_point_in_time
from tablewright.operators.overlap import EXACT, GROUPS, ROUNDED, shared_counts
from tablewright.operators.proxies import audited_features, separable, target_proxies
from tablewright.plans.options import POST_OUTCOME_PATTERNS, AuditOptions
from tablewright.plans.split_plan import RANDOM, TIME_BASED

# Severities, check ids and detail keys.
INFO, WARNING, CRITICAL = "info", "warning", "critical"
SEVERITY_RANK = {INFO: 0, WARNING: 1, CRITICAL: 2}

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("check", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class FittedOn:
    """A step of a feature pipeline, its columns, and the dataset it was fitted on."""

    pipeline: str
    step: str
    columns: tuple[str, ...]
    dataset_id: str | None


@dataclass
class Measured:
    """What the audit found out, before anything is judged."""

    proxies: list = field(default_factory=list)
    unaudited: list[str] = field(default_factory=list)
    unseparated: bool = False
    shared: dict[str, int] = field(default_factory=dict)
    decimals: int = 0
    group: str | None = None
    time: str | None = None
    by_time: bool = False
    dates: list[str] = field(default_factory=list)
    train_end: str | None = None
    test_start: str | None = None
    in_order: bool | None = None
    late_names: list[str] = field(default_factory=list)
    fitted: list[FittedOn] = field(default_factory=list)
    train_id: str | None = None

    @property
    def contaminated(self) -> list[FittedOn]:
        return [f for f in self.fitted if f.dataset_id != self.train_id]

    @property
    def nearly_shared(self) -> int:
        return max(0, self.shared[ROUNDED] - self.shared[EXACT])

    @property
    def limits(self) -> dict:
        """What the checks of single columns did not look at."""
        skipped = {"not_audited": ", ".join(self.unaudited)} if self.unaudited else {}
        return skipped | ({"threshold_separation": "not applicable"} if self.unseparated else {})


@dataclass(frozen=True)
class Rule:
    applies: Callable[[Measured], bool]
    severity: str | Callable[[Measured], str]
    says: Callable[[Measured], str]
    columns: Callable[[Measured], list[str]] = lambda m: []
    details: Callable[[Measured], dict] = lambda m: {}


def _always(m: Measured) -> bool:
    return True


def _edges(m: Measured) -> dict:
    return {"max_train": m.train_end, "min_test": m.test_start}


VERDICTS: dict[str, tuple[str, tuple[Rule, ...]]] = {
    "target_proxy": (
        "Target in disguise",
        (
            Rule(
                lambda m: m.proxies,
                CRITICAL,
                lambda m: f"Knowing {len(m.proxies)} of the columns is as good as knowing the target. Find out "
                "where they come from before training on them.",
                lambda m: [p["column"] for p in m.proxies],
                lambda m: {
                    p["column"]: json.dumps({"signal": p["signal"], "value": p["value"]}) for p in m.proxies
                }
                | m.limits,
            ),
            Rule(_always, INFO, lambda m: "None of the audited columns gives the target away.", details=lambda m: m.limits),
        ),
    ),
    "row_overlap": (
        "Rows on both sides",
        (
            Rule(
                lambda m: m.shared[EXACT],
                CRITICAL,
                lambda m: f"{m.shared[EXACT]} different rows of test were there in training too; a score "
                "on them measures memory.",
                details=lambda m: {"shared_rows": m.shared[EXACT]},
            ),
            Rule(_always, INFO, lambda m: "The sides have no row in common."),
        ),
    ),
    "near_duplicates": (
        "Rows that rounding makes equal",
        (
            Rule(
                lambda m: m.nearly_shared,
                WARNING,
                lambda m: f"With {m.decimals} decimals, {m.nearly_shared} more rows are on both sides. Check "
                "whether something was recorded twice.",
                details=lambda m: {"near_duplicates": m.nearly_shared, "exact_duplicates": m.shared[EXACT]},
            ),
            Rule(_always, INFO, lambda m: "Rounding brings no further rows together."),
        ),
    ),
    "temporal_leak": (
        "Order in time",
        (
            Rule(
                lambda m: m.time is None and m.dates,
                WARNING,
                lambda m: "The table has times, the split was made without them. Forecasts would be "
                "trained on days after those they are tested on.",
                lambda m: m.dates,
            ),
            Rule(lambda m: m.time is None, INFO, lambda m: "No column holds points in time: nothing to check."),
            Rule(
                lambda m: m.in_order is None,
                INFO,
                lambda m: "One of the sides has no times to compare.",
                lambda m: [m.time],
            ),
            Rule(
                lambda m: m.in_order,
                INFO,
                lambda m: f"Training stops at {m.train_end}, before test begins at {m.test_start}.",
                lambda m: [m.time],
                _edges,
            ),
            Rule(
                _always,
                lambda m: CRITICAL if m.by_time else WARNING,
                lambda m: f"Training runs on to {m.train_end} although test begins at {m.test_start}.",
                lambda m: [m.time],
                _edges,
            ),
        ),
    ),
    "group_leak": (
        "Groups on both sides",
        (
            Rule(lambda m: m.group is None, INFO, lambda m: "No column was named that groups rows: nothing to check."),
            Rule(
                lambda m: m.shared[GROUPS],
                CRITICAL,
                lambda m: f"'{m.group}' has {m.shared[GROUPS]} groups with rows on both sides, so test asks "
                "about old acquaintances.",
                lambda m: [m.group],
                lambda m: {"shared_groups": m.shared[GROUPS]},
            ),
            Rule(_always, INFO, lambda m: f"Each group of '{m.group}' is on one side.", lambda m: [m.group]),
        ),
    ),
    "pipeline_contamination": (
        "Steps fitted on more than train",
        (
            Rule(lambda m: not m.fitted, INFO, lambda m: "Not applicable: there are no fitted feature steps to look into."),
            Rule(
                lambda m: m.contaminated,
                CRITICAL,
                lambda m: f"{len(m.contaminated)} of {len(m.fitted)} feature steps learned from rows outside train. "
                "Fit them again on train alone.",
                lambda m: list(dict.fromkeys(c for f in m.contaminated for c in f.columns)),
                lambda m: {f"{f.pipeline}: {f.step}": f"fitted on {f.dataset_id}" for f in m.contaminated},
            ),
            Rule(_always, INFO, lambda m: f"All {len(m.fitted)} feature steps were fitted on train."),
        ),
    ),
    "post_outcome_names": (
        "Names of things known later",
        (
            Rule(
                lambda m: m.late_names,
                WARNING,
                lambda m: "Going by their names, these columns get their values once the outcome is there. "
                "Someone who knows the data should confirm or deny it.",
                lambda m: m.late_names,
                lambda m: {k: v for k, v in m.limits.items() if k == "not_audited"},
            ),
            Rule(
                _always,
                INFO,
                lambda m: "No name of an audited column points to a later moment.",
                details=lambda m: {k: v for k, v in m.limits.items() if k == "not_audited"},
            ),
        ),
    ),
}


def judge(check: str, m: Measured) -> dict:
    """The row of a check: the first of its rules that applies."""
    title, rules = VERDICTS[check]
    rule = next(r for r in rules if r.applies(m))
    severity = rule.severity if isinstance(rule.severity, str) else rule.severity(m)
    return {
        "check": check,
        "title": title,
        "severity": severity,
        "message": rule.says(m),
        "columns": list(rule.columns(m)),
        "details": {k: str(v) for k, v in rule.details(m).items()},
    }


def audit(
    train: DataFrame,
    test: DataFrame,
    target: str,
    *,
    strategy: str = RANDOM,
    time_column: str | None = None,
    group_column: str | None = None,
    options: AuditOptions = AuditOptions(),
    fitted: list[FittedOn] | None = None,
    train_id: str | None = None,
) -> DataFrame:
    """The seven checks, one row each, also for those that passed or do not apply.

    It looks at the two frames it is given, not at how they were meant to be split. `strategy`,
    `time_column` and `group_column` say what was declared about them; `fitted` are the feature steps
    that are used with the split, of which each should have the id of train as its dataset. Each measurement reads the
    frames anew: hand over written partitions rather than the plan of a split.
    """
    for name in filter(None, (target, time_column, group_column)):
        if name not in train.columns:
            raise ValueError(f"column '{name}' is not in the split")
    m = Measured(decimals=options.decimals, group=group_column, fitted=fitted or [], train_id=train_id)
    m.shared = shared_counts(train, test, options.decimals, group_column)
    features, m.unaudited = audited_features(train, target, options)
    m.unseparated = not separable(train, target, options)
    m.proxies = target_proxies(train, target, options).orderBy("position").collect()
    m.late_names = late_names(train, [f.name for f in features])
    measure_times(m, train, test, time_column, strategy)
    rows = [
        tuple({"position": position, **judge(check, m)}[name] for name in REPORT_SCHEMA.names)
        for position, check in enumerate(VERDICTS)
    ]
    return train.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def time_ranges(train: DataFrame, test: DataFrame, time_column: str) -> DataFrame:
    """One row: max_train and min_test."""
    sides = train.select(col(time_column).alias("train"), F.lit(None).alias("test")).unionByName(
        test.select(F.lit(None).alias("train"), col(time_column).alias("test"))
    )
    return sides.agg(F.max("train").alias("max_train"), F.min("test").alias("min_test"))


def measure_times(
    m: Measured, train: DataFrame, test: DataFrame, time_column: str | None, strategy: str
) -> None:
    m.time, m.by_time = time_column, strategy == TIME_BASED
    if time_column is None:
        m.dates = [f.name for f in train.schema.fields if is_point_in_time(f.dataType)]
        return
    edge = (
        time_ranges(train, test, time_column)
        .select(
            F.col("max_train").cast("string").alias("max_train"),
            F.col("min_test").cast("string").alias("min_test"),
            (F.col("max_train") <= F.col("min_test")).alias("in_order"),
        )
        .first()
    )
    m.train_end, m.test_start, m.in_order = edge["max_train"], edge["min_test"], edge["in_order"]


def check_temporal(
    train: DataFrame, test: DataFrame, time_column: str | None, strategy: str
) -> dict:
    m = Measured()
    measure_times(m, train, test, time_column, strategy)
    return judge("temporal_leak", m)


def post_outcome_names(features: DataFrame) -> DataFrame:
    """The rows of a (position, name) frame whose name suggests a value known only afterwards."""
    pattern = "(?i)" + "|".join(POST_OUTCOME_PATTERNS)
    return features.filter(F.col("name").rlike(pattern))


def late_names(train: DataFrame, features: list[str]) -> list[str]:
    if not features:
        return []
    names = train.sparkSession.createDataFrame(list(enumerate(features)), "position int, name string")
    return [r["name"] for r in post_outcome_names(names).orderBy("position").collect()]


def highest_severity(report: DataFrame) -> str:
    """The worst severity of a report; info if it is empty."""
    ranks = F.create_map(*[F.lit(v) for pair in SEVERITY_RANK.items() for v in pair])
    row = report.agg(F.max_by("severity", ranks[F.col("severity")]).alias("worst")).first()
    return row["worst"] or INFO
