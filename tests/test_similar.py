import math
import random

import pytest

from tablewright import similar_rows
from tablewright.operators import similar


def kind(x):
    if x is None:
        return "null"
    return "number" if math.isfinite(x) else str(x)


def brute(row, train, scales, numbers, categories, differing):
    for other in train:
        if any(kind(row[i]) != kind(other[i]) for i in numbers):
            continue
        apart = [(row[i] - other[i]) / s for i, s in zip(numbers, scales) if kind(row[i]) == "number"]
        if sum(x * x for x in apart) <= 1 and sum(row[i] != other[i] for i in categories) <= differing:
            return True
    return False


def table(rng, n, start):
    rows = []
    for i in range(n):
        x, y, z = rng.uniform(-30, 30), rng.randrange(40), rng.gauss(0, 8)
        if i % 9 == 0:
            x = rng.choice([None, math.nan, math.inf, -math.inf, 0.0])
        if i % 11 == 0:
            y = None
        if i % 4 == 0:  # a hot group
            x, y, z = 5 + rng.random() / 10, 7, 0.5
        rows.append((start + i, x, y, z, rng.choice("abc"), rng.choice([None, "u", "v"]), rng.choice("pq")))
    return rows


SCHEMA = "row bigint, x double, n0 int, z double, a string, b string, `c.d` string"


@pytest.mark.parametrize("differing", [0, 1, 2])
@pytest.mark.parametrize("seed", [0, 5])
def test_against_all_pairs(spark, differing, seed):
    rng = random.Random(seed)
    train, test = table(rng, 250, 0), table(rng, 150, 1000)
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (test, train)]
    got = similar_rows(*frames, {"x": 2.0, "n0": 5, "z": 3.0}, ["a", "b", "c.d"], differing, seed)
    assert got.columns == ["row", "x", "n0", "z", "a", "b", "c.d", "similar"]
    found = {r[0]: r["similar"] for r in got.collect()}
    expected = {r[0]: brute(r, train, (2, 5, 3), (1, 2, 3), (4, 5, 6), differing) for r in test}
    assert found == expected
    assert 10 < sum(found.values()) < 145


def test_numbers_alone_and_categories_alone(spark):
    rng = random.Random(3)
    train, test = table(rng, 60, 0), table(rng, 60, 1000)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (test, train)]
    found = {r[0]: r["similar"] for r in similar_rows(*frames, {"z": 0.2}).collect()}
    assert found == {r[0]: brute(r, train, (0.2,), (3,), (), 0) for r in test}
    found = {r[0]: r["similar"] for r in similar_rows(*frames, {}, ["a", "b", "c.d"], 1).collect()}
    assert found == {r[0]: brute(r, train, (), (), (4, 5, 6), 1) for r in test}


def test_repeated_rows_types_and_empty_tables(spark):
    test = spark.createDataFrame([(1, "a", True), (1, "a", False), (None, "a", True), (9, None, True)], "v int, k string, similar boolean")
    train = spark.createDataFrame([(2, "a"), (2, "a"), (None, None)], "v bigint, k string")
    got = similar_rows(test, train, {"v": 1}, ["k"])
    assert got.columns == ["v", "k", "similar"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", True), (1, "a", True), (9, None, False), (None, "a", False)]
    assert similar_rows(test, train.limit(0), {"v": 1}, ["k"]).filter("similar").count() == 0
    assert similar_rows(test.limit(0), train, {"v": 1}, ["k"]).count() == 0


def test_large_numbers(spark):
    base = [0.0, 1e6, 5e8, 3e9, 7e11, 1e300]
    train = spark.createDataFrame([(b,) for b in base], "v double")
    rows = [(b + d, abs((b + d) - b) <= 1) for b in base for d in (-1.0, -0.9, 0.0, 1.0, 1.5)]
    test = spark.createDataFrame(rows, "v double, expected boolean")
    assert similar_rows(test, train, {"v": 1.0}).filter("similar <> expected").count() == 0


def test_no_table_of_pairs_on_a_hot_group(spark):
    """Rows of a hot group are settled by their boxes: those that look through buckets do not grow with it."""
    opened = []
    original = similar.stage

    def counted(df):
        staged = original(df)
        opened.append(staged.count())
        return staged

    for n in (400, 4000):
        rng = random.Random(n)
        hot = [(5 + rng.random() / 100, "a") for _ in range(n)]
        frame = spark.createDataFrame(hot + [(1000.0 + i * 10, "a") for i in range(20)], "v double, k string")
        similar.stage = counted
        try:
            found = similar_rows(frame, frame.filter("v < 1000"), {"v": 1.0}, ["k"])
        finally:
            similar.stage = original
        assert found.filter("similar").count() == n
    assert opened[2::3] == [20, 20]


@pytest.mark.parametrize(
    ("scales", "categories", "differing"),
    [({}, [], 0), ({"v": 0}, [], 0), ({"v": math.inf}, [], 0), ({}, ["k"], 1), ({}, ["k"], -1), ({"v": 1}, ["v"], 0), ({"k": 1}, [], 0)],
)
def test_refusals(spark, scales, categories, differing):
    df = spark.createDataFrame([(1, "a")], "v int, k string")
    with pytest.raises(ValueError):
        similar_rows(df, df, scales, categories, differing)
