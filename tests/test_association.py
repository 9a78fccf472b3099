import math
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest

from tablewright.operators import association
from tablewright.operators.association import associations, spearman

NAN, INF = float("nan"), float("inf")


def rows():
    out = []
    for i in range(300):
        a = None if i % 7 == 0 else float(i * 37 % 41)
        b = NAN if i % 7 == 0 else [INF, -INF, 5.0, i * i % 83 / 2, 5.0][i % 5]
        c = None if i % 4 == 1 else i * 13 % 19 - 9
        d = (1 << 53) + (i * 7 % 11)
        out.append((i, a, b, c, d, 4, None))
    return out


SCHEMA = "id int, a double, b float, c int, d bigint, e int, f double"


@pytest.mark.parametrize("hot", [1000, 10, 1])
def test_spearman_ranks_the_common_rows_of_a_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(association, "HOT", hot)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = {(r.row_name, r.column_name): r.r for r in spearman(df).collect()}
    frame = pd.DataFrame(rows(), columns=df.columns, dtype=object)
    assert len(got) == 49
    for x, y in combinations(df.columns, 2):
        both = [(p, q) for p, q in zip(frame[x], frame[y]) if p is not None and q is not None and p == p and q == q]
        assert got[x, y] == got[y, x]
        ranks = [pd.Series(sorted(range(len(both)), key=lambda k: both[k][s])) for s in (0, 1)]
        if len({p for p, _ in both}) < 2 or len({q for _, q in both}) < 2:
            assert got[x, y] is None
            continue
        means = []
        for s in (0, 1):  # average ranks with Python's own comparisons
            values = [p[s] for p in both]
            ordered = sorted(values)
            first, n = {}, Counter(values)
            for k, v in enumerate(ordered):
                first.setdefault(v, k)
            means.append(pd.Series([first[v] + (n[v] + 1) / 2 for v in values]))
        assert got[x, y] == pytest.approx(means[0].corr(means[1]), abs=1e-12), (x, y)
        assert len(ranks[0]) == len(means[0])


def test_spearman_of_little(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert spearman(df.select("a")).collect() == []
    empty = {(r.row_name, r.column_name): r.r for r in spearman(df.limit(0).select("a", "c")).collect()}
    assert empty == {("a", "a"): 1.0, ("c", "c"): 1.0, ("a", "c"): None, ("c", "a"): None}
    with pytest.raises(ValueError):
        spearman(df.selectExpr("a", "'x' s"), ["a", "s"])


def test_many_columns_and_ranges(spark):
    many = spark.range(700).selectExpr("id", *[f"(id * {2 * i + 3}) % 701 AS v{i:03d}" for i in range(60)]).drop("id")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {(r.row_name, r.column_name): r.r for r in spearman(many).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = many.toPandas().corr("spearman")
    assert len(got) == 3600
    assert all(got[x, y] == pytest.approx(want.loc[x, y], abs=1e-10) for x in want for y in want)


@pytest.mark.parametrize("held, hot", [(0, 1000), (0, 4), (25, 20)])
def test_spearman_of_columns_with_many_values(spark, monkeypatch, held, hot):
    """Columns whose ranks are joined, two at a time, with gaps and a value that fills half of one."""
    data = [(None if i % 3 else -i % 50, 7 if i % 2 else i, i * 7 % 101 / -4, None if i % 3 else i % 9 * 0.5, i % 5, NAN, 1.5) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b bigint, c float, d double, e int, f double, g double").repartition(3)
    want = {(r.row_name, r.column_name): r.r for r in spearman(df).collect()}
    monkeypatch.setattr(association, "HELD", held)
    monkeypatch.setattr(association, "HOT", hot)
    monkeypatch.setattr(association, "TOGETHER", 2)
    got = {(r.row_name, r.column_name): r.r for r in spearman(df).collect()}
    frame = df.toPandas().astype(float).corr("spearman")
    assert set(got) == set(want) and len(got) == 49
    for (x, y), r in got.items():
        if x == y:
            assert r == 1.0
        elif "f" in (x, y) or "g" in (x, y):
            assert r is None and want[x, y] is None
        else:
            assert r == pytest.approx(want[x, y], abs=1e-12) and r == pytest.approx(frame.loc[x, y], abs=1e-12), (x, y)


def brute(pairs):
    n, cells = len(pairs), Counter(pairs)
    left, right = Counter(p for p, _ in pairs), Counter(q for _, q in pairs)
    phi = sum(c * c / (left[p] * right[q]) for (p, q), c in cells.items()) - 1
    least = min(len(left), len(right)) - 1
    mutual = sum(c / n * math.log(c * n / (left[p] * right[q])) for (p, q), c in cells.items())
    return n, math.sqrt(max(phi, 0) / least) if least else None, mutual


def test_associations_of_mixed_columns(spark):
    data = []
    for i in range(400):
        k = None if i % 9 == 0 else f"k{i % 5}"
        data.append((k, i % 5 == 2, i % 4, NAN if i % 50 == 0 else (i * 37 % 400) / 7, f"u{i}", None, "only", k))
    df = spark.createDataFrame(data, "k string, t boolean, n int, x double, u string, z string, o string, `k 2` string")
    got = {(r.row_name, r.column_name): (r.rows, r.cramers_v, r.mutual_information) for r in associations(df.repartition(3)).collect()}
    x = pd.Series([r[3] for r in data]).dropna()
    edges = x.quantile([0.25, 0.5, 0.75]).tolist()
    coded = [(*r[:3], None if r[3] != r[3] else sum(r[3] > e for e in edges), *r[4:]) for r in data]
    want = {}
    for i, j in combinations(range(8), 2):
        pairs = [(r[i], r[j]) for r in coded if r[i] is not None and r[j] is not None]
        if pairs:
            want[df.columns[i], df.columns[j]] = brute(pairs)
    assert set(got) == set(want)
    for p, (n, v, mutual) in want.items():
        assert (got[p][0], got[p][2]) == (n, pytest.approx(mutual, abs=1e-9)), p
        assert (got[p][1] is None) if v is None else got[p][1] == pytest.approx(v, abs=1e-7), (p, v, got[p])
    assert got["k", "k 2"][1] == pytest.approx(1.0)
    assert associations(df.limit(0)).collect() == [] and associations(df, ["k"]).collect() == []
