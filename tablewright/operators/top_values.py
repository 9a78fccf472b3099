"""Most frequent values of many text columns in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import col


def top_value_counts(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """Rows (column, rank, value, count): the k most frequent values, ties by value, no nulls.

    Counts are combined before the shuffle, so a hot value costs one row per task. The rank filter
    becomes a group limit on both sides of the second shuffle: at most k rows per column and task
    reach the window.
    """
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, rank int, value string, count bigint"
        )
    texts = F.array(*[col(n).cast("string") for n in names])
    cells = df.select(F.posexplode(texts).alias("position", "value")).filter("value IS NOT NULL")
    # Two hashes stand for a text in the shuffle; of each group only one copy of it travels along.
    counts = (
        cells.groupBy("position", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("value"))
        .drop("h1", "h2")
    )
    frequent_first = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    labels = F.array(*[F.lit(n) for n in names])
    return (
        counts.withColumn("rank", F.row_number().over(frequent_first))
        .filter(F.col("rank") <= k)
        .select(labels[F.col("position")].alias("column"), "rank", "value", "count")
    )
