import math

import pytest
from pyspark.sql import functions as F

from tablewright.llm.mixing import mix, poisson_tables, repetition_means, source_sizes


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "x" * (50 + i % 7), "big" if i % 10 else "small", -1) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, replica int")


def test_shares_meet_the_weights(spark, docs):
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("none", 5.0)], "source string, weight double")
    weights = weights.filter("source <> 'none'")
    mixed = mix(docs, weights)
    assert sorted(mixed.columns) == ["doc_id", "replica", "shuffle_key", "source", "text"]
    sizes = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    # Half of all characters each; the spread of a Poisson sum is below two per cent here.
    assert sizes["small"] == pytest.approx(total / 2, rel=0.1)
    assert sizes["big"] == pytest.approx(total / 2, rel=0.1)


def test_counts_are_the_inverse_distribution_and_repeat(docs):
    first, again = (mix(docs, exponent=0.5, seed=3).select("doc_id", "replica", "shuffle_key") for _ in (0, 1))
    rows = first.collect()
    assert sorted(rows) == sorted(again.repartition(5).collect())
    assert len(set((r.doc_id, r.replica) for r in rows)) == len(rows)
    other = mix(docs, exponent=0.5, seed=4).select("doc_id", "replica", "shuffle_key").collect()
    assert sorted(other) != sorted(rows)
    counts = {}
    for r in rows:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert 0 <= r.shuffle_key < 1
    # The small source has a mean of 3 * sqrt(...): copies spread as a Poisson variable does.
    small = [counts.get(i, 0) for i in range(0, 4000, 10)]
    mean = sum(small) / len(small)
    variance = sum((c - mean) ** 2 for c in small) / len(small)
    assert variance == pytest.approx(mean, rel=0.3)


def test_tables_hold_the_distribution(spark):
    means = spark.createDataFrame([("a", 0.0), ("b", 2.5), ("c", 1000.0)], "source string, mean double")
    found = {r.source: r for r in poisson_tables(means).collect()}
    assert found["a"].cdf[0] == 1.0
    assert found["b"].parts == 1 and found["b"].cdf[3] == pytest.approx(
        sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4))
    )
    assert found["c"].parts == 4 and found["c"].cdf[-1] == pytest.approx(1.0)


def test_nulls_empty_tables_and_zero_weights(spark):
    rows = [(None, "a", None), (1, None, None), (1, "b", "s"), (2, "", "t"), (1, "b", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs, epochs=40.0)
    assert {r.source for r in got.collect()} <= {None, "s"}  # t has no characters
    assert got.filter("source is null").count() > 0
    per_row = got.filter("source = 's'").groupBy("replica").count().collect()
    assert all(r["count"] == 2 for r in per_row)  # equal rows are drawn alike
    assert mix(docs.limit(0)).count() == 0
    none = spark.createDataFrame([("s", 0.0)], "source string, weight double")
    assert mix(docs, none).count() == 0
    sizes = source_sizes(docs, F.length("text"))
    negative = spark.createDataFrame([("s", -3.0), (None, 1.0)], "source string, weight double")
    means = {r.source: r["mean"] for r in repetition_means(sizes, negative).collect()}
    assert means["s"] == 0 and means["t"] == 0 and means[None] == pytest.approx(3.0)
