import numpy as np
import pytest

from tablewright.operators.outliers import outliers
from tablewright.operators.rules import Between, Holds, Matches, NotNull, OneOf, References, RuleError, Unique, check_rules

NAN = float("nan")


def test_rules_count_the_rows_that_break_them(spark):
    rows = [(1, "a", 5.0, "x"), (1, "a", -1.0, None), (2, None, NAN, "y"), (None, "b", None, "zz"), (None, "b", 3.0, "x"), (3, "b", 9.0, "x")]
    df = spark.createDataFrame(rows, "id int, k string, v double, `odd name` string").repartition(3)
    other = spark.createDataFrame([(1, "a"), (1, "a"), (9, "b"), (None, "b")], "id int, kk string")
    rules = [
        NotNull("id"), NotNull("v", "warning"), Between("v", 0), Between("v", None, 5.0), Between("v"), OneOf("odd name", ("x", "y")),
        OneOf("k", ()), Matches("odd name", "^[xy]$"), Holds("v > 0 OR id = 1"), Holds("id < k"), Unique(("id",)), Unique(("id", "k")),
        Unique(("v",)), References(("id", "k"), "t", ("id", "kk")), References(("k",), "t", ("kk",)),
    ]
    got = check_rules(df, rules[:9] + rules[10:], {"t": other}).orderBy("position").collect()
    assert [r.failing for r in got] == [2, 1, 1, 2, 0, 1, 5, 1, 0, 2, 2, 0, 1, 0]
    assert all(r.rows == 6 and r.passed == (r.failing == 0) for r in got)
    assert got[1].severity == "warning" and got[5].columns == ["odd name"]
    assert all(r.passed and r.rows == 0 for r in check_rules(df.limit(0), rules[:9] + rules[10:], {"t": other}).collect())
    assert check_rules(df, []).collect() == []
    for wrong in (NotNull("no"), Unique(("no",)), Unique(()), References(("id",), "u", ("id",)), References(("id",), "t", ("kk",)),
                  References(("id",), "t", ("no",)), References(("id",), "t", ("id", "kk"))):
        with pytest.raises(RuleError):
            check_rules(df, [wrong], {"t": other})


def test_outliers_by_fences_and_deviations(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=200), [50.0, -40.0, 9.0]]
    rows = [(float(v), int(i % 3), 5.0, None, "t", float("inf") if i % 50 == 0 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows + [(NAN, None, 6.0, None, "t", None)], "v double, n int, c double, z double, t string, w double")
    got = {r.name: r for r in outliers(df.repartition(3)).collect()}
    assert list(got) == ["v", "n", "c", "z", "w"]
    for name, own in (("v", values), ("n", np.arange(203) % 3), ("w", np.array([v for i, v in enumerate(values) if i % 50]))):
        q = np.quantile(own, [0.25, 0.5, 0.75])
        low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        mad = np.median(np.abs(own - q[1]))
        r = got[name]
        assert (r.filled, r.below, r.above) == (len(own), (own < low).sum(), (own > high).sum())
        assert [r.p25, r.p50, r.p75, r.low_fence, r.high_fence, r.mad] == pytest.approx([*q, low, high, mad])
        assert r.far == (np.abs(own - q[1]) > 3.5 * 1.4826 * mad).sum()
    assert (got["c"].below, got["c"].above, got["c"].mad, got["c"].far) == (0, 1, 0.0, 1)
    assert (got["z"].filled, got["z"].low_fence, got["z"].below, got["z"].far) == (0, None, 0, 0)
    assert outliers(df.select("t")).collect() == [] and outliers(df.limit(0).select("v")).first().filled == 0
    with pytest.raises(ValueError):
        outliers(df, ["t"])
