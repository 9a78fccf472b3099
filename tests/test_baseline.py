import math

import numpy as np
import pytest

from tablewright.operators.baseline import calibration, classification_quality, linear_regression, logistic_regression

NAN = float("nan")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(1e6, 3, 500), rng.integers(0, 5, 500), rng.normal(0, 1e-4, 500)
    y = 3 * (a - 1e6) - 2 * b + 4e4 * c + 7 + rng.normal(0, 0.5, 500)
    t = (rng.random(500) < 1 / (1 + np.exp(-(0.4 * (a - 1e6) - 0.7 * b + 0.5)))).astype(int)
    return a, b, c, y, t


@pytest.fixture(scope="module")
def df(spark, data):
    a, b, c, y, t = data
    rows = [(float(a[i]), int(b[i]), float(c[i]), float(y[i]), bool(t[i]), int(t[i]), 2.0) for i in range(500)]
    rows += [(None, 1, 1.0, 1.0, True, 1, 2.0), (NAN, 1, 1.0, 1.0, True, 1, 2.0), (1.0, 1, 1.0, float("inf"), None, None, 2.0)]
    return spark.createDataFrame(rows, "a double, b int, c double, y double, t boolean, t01 int, k double").repartition(4)


def test_least_squares_equal_a_direct_solve(spark, df, data):
    a, b, c, y, _ = data
    model = linear_regression(df, "y", ["a", "b", "c"])
    direct = np.linalg.lstsq(np.column_stack([np.ones(500), a - 1e6, b, c]), y, rcond=None)[0]
    assert model.rows == 500 and model.coefficients == pytest.approx(direct[1:], rel=1e-8)
    assert model.intercept + model.coefficients[0] * 1e6 == pytest.approx(direct[0], rel=1e-6)
    got = model.predict(df).select("a", "b", "c", "prediction").collect()
    assert sum(r.prediction is None for r in got) == 2
    r = next(r for r in got if r.prediction is not None and r.a > 1e5)
    assert r.prediction == pytest.approx(direct @ [1, r.a - 1e6, r.b, r.c], abs=1e-6)
    assert [r.feature for r in model.table(spark).orderBy("position").collect()] == [None, "a", "b", "c"]


def test_dependent_and_constant_features(df):
    alone = linear_regression(df, "y", ["b"])
    twice = linear_regression(df.withColumn("b2", df.b * 2), "y", ["b", "b2", "k"])
    assert twice.coefficients[0] + 2 * twice.coefficients[1] == pytest.approx(alone.coefficients[0])
    assert twice.coefficients[2] == pytest.approx(0, abs=1e-9)
    none = linear_regression(df.limit(0), "y", ["a"])
    assert (none.rows, none.coefficients, none.intercept) == (0, (0.0,), 0.0)


@pytest.mark.parametrize("target,l2", [("t", 0.0), ("t01", 3.0)])
def test_the_likelihood_has_no_slope_left(df, data, target, l2):
    a, b, _, _, t = data
    model = logistic_regression(df, target, ["a", "b"], l2)
    x = np.column_stack([a, b])
    p = 1 / (1 + np.exp(-(model.intercept + x @ np.array(model.coefficients))))
    # The rows that the fixture adds have no usable `a` or target.
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    weights = np.array(model.coefficients) * x.std(0, ddof=1)
    assert model.converged and model.rows == 500
    assert np.abs(z.T @ (t - p) - l2 * weights).max() < 1e-6 and abs((t - p).sum()) < 1e-6


def test_divided_classes_and_wrong_targets(spark, df):
    apart = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "x double, y int")
    model = logistic_regression(apart, "y", ["x"], steps=8)
    assert not model.converged and model.steps == 8
    assert logistic_regression(apart, "y", ["x"], l2=1.0).converged
    assert logistic_regression(apart.limit(0), "y", ["x"]).rows == 0
    with pytest.raises(ValueError):
        logistic_regression(df, "b", ["a"])
    with pytest.raises(ValueError):
        linear_regression(apart.withColumn("s", apart.y.cast("string")), "s", ["x"])


def test_quality_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(round(float(rng.random()), 1), int(rng.random() < 0.3)) for _ in range(300)] + [(None, 1), (NAN, 0), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y int").repartition(3)
    known = [(s, y) for s, y in rows if s is not None and s == s and y is not None]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    [r] = classification_quality(df, "s", "y").collect()
    assert (r.rows, r.positives) == (300, len(pos)) and r.auc == pytest.approx(auc, abs=1e-12)
    assert r.brier == pytest.approx(sum((s - y) ** 2 for s, y in known) / 300)
    clipped = [(min(max(s, 1e-15), 1 - 1e-15), y) for s, y in known]
    assert r.log_loss == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in clipped) / 300)
    bins = {r.bin: r for r in calibration(df, "s", "y", 4).collect()}
    for k, found in bins.items():
        own = [(s, y) for s, y in known if min(int(s * 4), 3) == k]
        assert found.rows == len(own) and found.positive_rate == pytest.approx(sum(y for _, y in own) / len(own))
    assert sum(r.rows for r in bins.values()) == 300
    for part in (df.limit(0), df.filter("y = 1")):
        [r] = classification_quality(part, "s", "y").collect()
        assert r.auc is None and r.rows == part.filter("s IS NOT NULL AND NOT isnan(s)").count()
