"""Fixed-width histograms of many columns in one scan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import finite_double

SCHEMA = "column string, bin int, bin_start double, bin_end double, count bigint"


def histogram_counts(df: DataFrame, statistics: list[dict], bins: int) -> DataFrame:
    """Rows (column, bin, bin_start, bin_end, count); empty bins are kept, with zero.

    A constant column has one bin, a column without finite values has none. The maximum belongs
    to the last bin. Counting is keyed by one small integer and combined before the shuffle, so
    what moves is bounded by columns x bins per task.
    """
    spark = df.sparkSession
    drawn = [s for s in statistics if s["finite"]]
    if not drawn:
        return spark.createDataFrame([], SCHEMA)
    # A constant column is one bin of any width.
    constant = [s["high"] <= s["low"] for s in drawn]
    last = [0 if c else bins - 1 for c in constant]
    width = [
        1.0 if c else (s["high"] - s["low"]) / bins for s, c in zip(drawn, constant, strict=True)
    ]
    layout = [
        (
            position * bins + b,
            s["field"].name,
            b,
            s["low"] + b * width[position],
            s["high"] if constant[position] else s["low"] + (b + 1) * width[position],
        )
        for position, s in enumerate(drawn)
        for b in range(last[position] + 1)
    ]
    # Looked up by position, so that the generated code does not grow with the columns.
    table = [
        {"low": s["low"], "width": width[position], "last": last[position]}
        for position, s in enumerate(drawn)
    ]
    edges = F.from_json(F.lit(json.dumps(table)), "array<struct<low:double,width:double,last:int>>")
    place = F.floor((F.col("value") - F.col("edge.low")) / F.col("edge.width"))
    inside = F.greatest(F.least(place, F.col("edge.last")), F.lit(0))
    values = F.array(*[finite_double(s["field"]) for s in drawn])
    counted = (
        df.select(F.posexplode(values).alias("position", "value"))
        .filter("value IS NOT NULL")
        .select("position", "value", edges[F.col("position")].alias("edge"))
        .groupBy((F.col("position") * bins + inside).cast("int").alias("code"))
        .count()
    )
    bars = spark.createDataFrame(
        layout, "code int, column string, bin int, bin_start double, bin_end double"
    )
    return bars.join(counted, "code", "left").select(
        "column", "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count")
    )
