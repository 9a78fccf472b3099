"""Each planted leak is found, and a clean split stays silent."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tablewright import AuditOptions, audit, highest_severity, target_proxies
from tablewright.operators.leakage import REPORT_SCHEMA
from tablewright.operators.overlap import EXACT, GROUPS, ROUNDED, shared_counts

CHECKS = [
    "target_proxy",
    "row_overlap",
    "near_duplicates",
    "temporal_leak",
    "group_leak",
    "pipeline_contamination",
    "post_outcome_names",
]
SCHEMA = "id bigint, edad bigint, ciudad string, fecha date, objetivo bigint"


def people(numbers, month: int):
    return [
        (i, 20 + i % 40, f"ciudad{i % 5}", dt.date(2024, month, i % 28 + 1), i % 3) for i in numbers
    ]


def frames(spark, train, test, schema=SCHEMA):
    return tuple(spark.createDataFrame(list(rows), schema).repartition(2) for rows in (train, test))


def checks(report) -> dict:
    return {r["check"]: r for r in report.collect()}


@pytest.fixture
def clean(spark):
    return frames(spark, people(range(1, 81), 1), people(range(200, 240), 6))


def proxies(train, target, options=AuditOptions()) -> dict:
    return {r["column"]: (r["signal"], r["value"]) for r in target_proxies(train, target, options).collect()}


def test_clean_split_raises_no_alarm(clean):
    report = audit(*clean, "objetivo", time_column="fecha")
    assert [r["check"] for r in report.orderBy("position").collect()] == CHECKS
    assert highest_severity(report) == "info"


def test_linear_copy_of_the_target(spark):
    train, test = frames(
        spark,
        [(i, i * 2, i) for i in range(1, 61)],
        [(i, i * 2, i) for i in range(200, 230)],
        "id bigint, copia bigint, objetivo bigint",
    )
    found = checks(audit(train, test, "objetivo"))["target_proxy"]
    assert found["severity"] == "critical" and found["columns"] == ["id", "copia"]
    assert json.loads(found["details"]["copia"]) == {"signal": "correlation", "value": 1.0}


def test_category_that_determines_the_target(spark):
    rows = [(i, "aprobado" if i % 2 else "rechazado", i % 2) for i in range(1, 81)]
    train, _ = frames(spark, rows, rows, "id bigint, codigo string, objetivo bigint")
    assert proxies(train, "objetivo") == {"codigo": ("functional_dependency", 1.0)}


def test_purity_below_the_threshold_is_no_dependency(spark):
    rows = [("a" if i % 2 else "b", i % 2 if i else 1) for i in range(50)]
    train, _ = frames(spark, rows, rows, "codigo string, objetivo bigint")
    assert proxies(train, "objetivo") == {}
    # Group b has two targets, so only the 25 rows of a are pure.
    assert proxies(train, "objetivo", AuditOptions(dependency_purity=0.5)) == {
        "codigo": ("functional_dependency", 0.5)
    }


def test_nulls_in_feature_and_target(spark):
    """A missing feature leaves the row out, a missing target is no target of its own."""
    rows = [("a", 1.0)] * 5 + [("a", None)] * 5 + [("b", None)] * 2 + [(None, 2.0)] * 8
    train, _ = frames(spark, rows, rows, "f string, t double")
    assert proxies(train, "t", AuditOptions(dependency_purity=0.8)) == {
        "f": ("functional_dependency", round(10 / 12, 4))
    }


def test_target_derived_by_a_threshold(spark):
    rows = [(i * 10, int(i * 10 > 500)) for i in range(1, 101)]
    train, _ = frames(spark, rows, rows, "monto bigint, compro bigint")
    assert proxies(train, "compro") == {"monto": ("threshold_separation", 1.0)}


def test_threshold_works_for_text_targets_and_stops_at_ten_classes(spark):
    for classes, expected in ((3, {"x": ("threshold_separation", 1.0)}), (11, {})):
        rows = [(float(i), f"c{i * classes // 110}") for i in range(110)]
        train, _ = frames(spark, rows, rows, "x double, c string")
        assert proxies(train, "c") == expected


def test_touching_or_overlapping_ranges_do_not_separate(spark):
    rows = [(i * 37 % 100, i % 2) for i in range(1, 101)]
    train, _ = frames(spark, rows, rows, "monto bigint, compro bigint")
    assert proxies(train, "compro") == {}
    rows = [(float(i // 50 + i % 50 / 49), i // 50) for i in range(100)]
    train, _ = frames(spark, rows, rows, "x double, y bigint")
    assert proxies(train, "y") == {}


def test_unknowable_columns_are_no_proxies(spark):
    nan = float("nan")
    rows = [(5.0, nan if i % 2 else 1.0, None, i, f"t{i}") for i in range(40)]
    train, _ = frames(
        spark, rows, rows, "flat double, broken double, empty double, target bigint, text string"
    )
    assert proxies(train, "target") == {}


def test_distinct_ratio_is_exact_at_the_edge(spark):
    """Twenty values in forty rows are half of them and still count, twenty-one are too many."""
    for values, expected in ((20, 1), (21, 0)):
        rows = [(f"v{i % values}", f"t{i % values}") for i in range(40)]
        train, _ = frames(spark, rows, rows, "v string, t string")
        assert len(proxies(train, "t")) == expected


def test_shared_rows(spark):
    shared = people(range(1, 11), 2)
    train, test = frames(spark, shared * 3 + people(range(50, 90), 2), shared + people(range(400, 430), 3))
    found = checks(audit(train, test, "objetivo"))
    assert found["row_overlap"]["severity"] == "critical"
    assert found["row_overlap"]["details"] == {"shared_rows": "10"}
    assert found["near_duplicates"]["severity"] == "info"


def test_near_duplicates(spark):
    train, test = frames(
        spark,
        [(i, i + 0.0000001, i % 2) for i in range(1, 41)],
        [(i, i + 0.0000009, i % 2) for i in range(1, 41)],
        "id bigint, medida double, objetivo bigint",
    )
    found = checks(audit(train, test, "objetivo"))
    assert found["row_overlap"]["severity"] == "info"
    assert found["near_duplicates"]["severity"] == "warning"
    assert found["near_duplicates"]["details"] == {"near_duplicates": "40", "exact_duplicates": "0"}


def test_what_counts_as_the_same_row(spark):
    nan, inf = float("nan"), float("inf")
    schema = "a string, b string, x double, n bigint"
    train = [(None, "a", 1.0, 2**60), ("k", "k", nan, 1), ("k", "k", -0.0, 1), ("k", "k", inf, 1), (None,) * 4]
    test = [("a", None, 1.0, 2**60), (None, "a", 1.0, 2**60 + 1), ("k", "k", nan, 1), ("k", "k", 0.0, 1), ("k", "k", inf, 1), (None,) * 4]
    counts = shared_counts(*frames(spark, train, test, schema), 3, "a")
    # Values in swapped columns and whole numbers beyond double precision are different rows.
    assert counts == {EXACT: 4, ROUNDED: 4, GROUPS: 2}


def test_column_order_of_test_does_not_matter(spark):
    train, test = frames(spark, people(range(5), 1), people(range(5), 1))
    assert shared_counts(train, test.select(*reversed(test.columns)), 3)[EXACT] == 5


def test_nested_columns(spark):
    rows = [([1, None], {"a": 1, "b": 2}, (None, 1))]
    other = [([None, 1], {"b": 2, "a": 1}, (1, None))]
    schema = "l array<int>, m map<string,int>, s struct<x:int,y:int>"
    train, test = frames(spark, rows, rows + other, schema)
    assert shared_counts(train, test, 3, "m") == {EXACT: 1, ROUNDED: 1, GROUPS: 1}
    assert shared_counts(train, frames(spark, rows, other, schema)[1], 3)[EXACT] == 0


def test_time(spark, clean):
    train, test = frames(
        spark,
        [(i, 30, "c", dt.date(2024, 10 + i % 2, 1), i % 2) for i in range(1, 41)],
        [(i, 30, "c", dt.date(2024, 1, 1), i % 2) for i in range(100, 130)],
    )
    for strategy, severity in (("time_based", "critical"), ("random", "warning")):
        found = checks(audit(train, test, "objetivo", strategy=strategy, time_column="fecha"))
        assert found["temporal_leak"]["severity"] == severity
        assert found["temporal_leak"]["details"] == {
            "max_train": "2024-11-01",
            "min_test": "2024-01-01",
        }
    undeclared = checks(audit(*clean, "objetivo"))["temporal_leak"]
    assert (undeclared["severity"], undeclared["columns"]) == ("warning", ["fecha"])
    dateless = checks(audit(*(f.drop("fecha") for f in clean), "objetivo"))["temporal_leak"]
    assert (dateless["severity"], dateless["columns"]) == ("info", [])


def test_missing_dates_cannot_be_compared(spark):
    rows = [(i, 30, "c", None, i % 2) for i in range(5)]
    found = checks(audit(*frames(spark, rows, rows), "objetivo", time_column="fecha"))
    assert found["temporal_leak"]["severity"] == "info"
    assert "no times to compare" in found["temporal_leak"]["message"]


def test_groups(spark, clean):
    found = checks(audit(*clean, "objetivo", group_column="ciudad"))["group_leak"]
    assert found["severity"] == "critical" and found["details"] == {"shared_groups": "5"}
    assert checks(audit(*clean, "objetivo", group_column="id"))["group_leak"]["severity"] == "info"
    # A missing group is a group.
    nulls = [(i, 1, None, None, 0) for i in range(3)]
    train, test = frames(spark, nulls, nulls)
    assert shared_counts(train, test, 3, "ciudad")[GROUPS] == 1


def test_names_are_only_a_suggestion(spark):
    names = ["resultado_final", "post_alta", "RESULT", "x_after", "final_grade", "postal", "after", "semifinal"]
    schema = ", ".join(f"{n} string" for n in names) + ", objetivo bigint"
    train, test = frames(spark, [("a",) * 8 + (1,)], [("b",) * 8 + (1,)], schema)
    found = checks(audit(train, test, "objetivo"))["post_outcome_names"]
    assert found["severity"] == "warning"
    assert found["columns"] == names[:5]


def test_pipeline_check_does_not_apply(clean):
    found = checks(audit(*clean, "objetivo"))["pipeline_contamination"]
    assert found["severity"] == "info" and "Not applicable" in found["message"]


@pytest.mark.parametrize("wrong", [{"target": "nope"}, {"target": "id", "group_column": "nope"}])
def test_unknown_columns_are_rejected(clean, wrong):
    with pytest.raises(ValueError, match="not in the split"):
        audit(*clean, **wrong)


def test_highest_severity(spark):
    def report(*severities):
        rows = [(i, "c", "t", s, "m", [], {}) for i, s in enumerate(severities)]
        return spark.createDataFrame(rows, REPORT_SCHEMA)

    assert highest_severity(report("info", "warning")) == "warning"
    assert highest_severity(report("critical", "warning")) == "critical"
    assert highest_severity(report()) == "info"


def test_rows_of_other_widths_are_the_same_rows(spark):
    rows = [(i, float(i), dt.date(2020, 1, 1 + i % 28)) for i in range(50)]
    train = spark.createDataFrame(rows, "a int, b float, c date")
    test = spark.createDataFrame(rows[:20], "a bigint, b double, c date").selectExpr(
        "cast(c as timestamp_ntz) c", "cast(a as decimal(20,0)) a", "b"
    )
    counts = shared_counts(train, test, 3, "a")
    assert counts == {"exact": 20, "rounded": 20, "groups": 20}


@pytest.mark.parametrize("changed", ["a", "a, b, 1 as d", "cast(a as string) as a, b", "a, array(b) as b"])
def test_sides_that_cannot_be_compared(spark, changed):
    train = spark.createDataFrame([(1, 2.0)], "a int, b double")
    with pytest.raises(ValueError):
        shared_counts(train, train.selectExpr(*changed.split(", ")), 3)


def test_columns_beyond_a_limit_are_named(spark):
    rows = [(i % 7, i, i * 31 % 50, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "harmless int, y int, other int, y_final int")
    whole = checks(audit(frame, frame, "y"))
    assert whole["target_proxy"]["columns"] == ["y_final"]
    assert whole["post_outcome_names"]["columns"] == ["y_final"]
    assert "not_audited" not in whole["target_proxy"]["details"]
    cut = checks(audit(frame, frame, "y", options=AuditOptions(max_features=2)))
    for check in ("target_proxy", "post_outcome_names"):
        assert cut[check]["severity"] == "info" and cut[check]["details"]["not_audited"] == "y_final"
    assert cut["target_proxy"]["details"]["threshold_separation"] == "not applicable"
