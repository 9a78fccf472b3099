"""Outliers of numeric columns: quartile fences and median absolute deviations, exactly.

A fixed number of jobs for any number of columns: quartiles by rank selection, the deviations from
the medians by another, and one count against all fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, finite_double
from tablewright.functions.kinds import NUMERIC, kind_of
from tablewright.operators.quantiles import QUARTILES, quantiles
from tablewright.operators.scalars import scalar_statistics

#: Makes the median absolute deviation of a normal distribution its standard deviation.
NORMAL = 1.4826

SCHEMA = (
    "position int, name string, filled bigint, p25 double, p50 double, p75 double, low_fence double, high_fence double, "
    "below bigint, above bigint, mad double, far bigint"
)


def outliers(df: DataFrame, columns: list[str] | None = None, fences: float = 1.5, deviations: float = 3.5) -> DataFrame:
    """One row per numeric column: finite values, quartiles, fences at `fences` quartile distances
    beyond the outer ones, how many values lie below and above them, the median absolute deviation,
    and how many values are more than `deviations` of it (scaled to a normal deviation) from the median.

    Null, NaN and infinite values take no part. A column without values has nulls and counts of 0; where
    the median absolute deviation is 0, `far` counts every value that is not the median.
    """
    fields = [df.schema[c] for c in columns] if columns else [f for f in df.schema if kind_of(f.dataType) == NUMERIC]
    wrong = [f.name for f in fields if kind_of(f.dataType) != NUMERIC]
    if wrong:
        raise ValueError(f"columns that are no numbers: {', '.join(wrong)}")
    spark = df.sparkSession
    if not fields:
        return spark.createDataFrame([], SCHEMA)
    names = [f"c{i}" for i in range(len(fields))]
    finite = df.select(*[finite_double(f).alias(n) for f, n in zip(fields, names)])
    _, statistics = scalar_statistics(finite, finite.schema.fields)
    found = quantiles(finite, statistics, QUARTILES)
    medians = [found[n][1] for n in names]
    gaps = finite.select(*[F.abs(col(n) - F.lit(m).cast("double")).alias(n) for n, m in zip(names, medians)])
    mads = quantiles(gaps, scalar_statistics(gaps, gaps.schema.fields)[1], (0.5,))
    limits = []
    for n in names:
        low, _, high = found[n]
        reach = None if low is None else fences * (high - low)
        limits.append((None, None) if low is None else (low - reach, high + reach))
    reaches = [None if mads[n][0] is None else deviations * NORMAL * mads[n][0] for n in names]

    def each(values: list[float | None]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("i"))

    long = finite.select(F.posexplode(F.array(*names)).alias("i", "x")).filter("x IS NOT NULL")
    counts = long.groupBy("i").agg(
        F.count_if(F.col("x") < each([low for low, _ in limits])).alias("below"),
        F.count_if(F.col("x") > each([high for _, high in limits])).alias("above"),
        F.count_if(F.abs(F.col("x") - each(medians)) > each(reaches)).alias("far"),
    )
    counted = {r.i: r for r in counts.collect()}
    rows = []
    for i, (f, n) in enumerate(zip(fields, names)):
        c = counted.get(i)
        numbers = (c.below, c.above, c.far) if c else (0, 0, 0)
        rows.append((i, f.name, statistics[i]["finite"], *found[n], *limits[i], *numbers[:2], mads[n][0], numbers[2]))
    return spark.createDataFrame(rows, SCHEMA)
