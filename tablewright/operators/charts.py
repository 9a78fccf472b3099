"""Derived views of a profile, as a dashboard shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.profile import Profile


def _columns(source: DataFrame | Profile, *statistics: str) -> DataFrame:
    """The rows of a profile, of which a profile computes only what is needed."""
    return source.columns(statistics) if isinstance(source, Profile) else source


def missing_bars(columns: DataFrame | Profile) -> DataFrame:
    """Columns with gaps: how many rows and which percentage, most gaps first."""
    return (
        _columns(columns)
        .filter("null_count > 0")
        .select(
            "name",
            "null_count",
            (F.col("null_fraction") * 100).alias("percent"),
        )
        .orderBy(F.desc("percent"), "name")
    )


def columns_with_gaps(columns: DataFrame | Profile) -> DataFrame:
    return _columns(columns).agg(F.count_if(F.col("null_count") > 0).alias("columns_with_gaps"))


def five_numbers(columns: DataFrame | Profile) -> DataFrame:
    """Minimum, quartiles and maximum of the numeric columns that have them."""
    found = _columns(columns, "quartiles")
    return found.filter("p25 IS NOT NULL").select("name", "min", "p25", "p50", "p75", "max")


def temporal_ranges(columns: DataFrame | Profile) -> DataFrame:
    """First and last moment of the temporal columns, as ISO text."""
    return _columns(columns).filter("kind = 'temporal'").select("name", "min_text", "max_text")


def boolean_distribution(columns: DataFrame | Profile) -> DataFrame:
    """Rows (name, value, count); the 'no data' row exists only where there are nulls."""
    bars = F.array(
        F.struct(F.lit("true").alias("value"), F.col("true_count").alias("count")),
        F.struct(F.lit("false").alias("value"), F.col("false_count").alias("count")),
        F.struct(F.lit("no data").alias("value"), F.col("null_count").alias("count")),
    )
    return (
        _columns(columns)
        .filter("kind = 'boolean'")
        .select("name", F.inline(bars))
        .filter("value <> 'no data' OR count > 0")
    )
