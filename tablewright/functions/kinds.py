"""Type families: which statistics make sense for a column."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = "numeric"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
CATEGORICAL = "categorical"
OTHER = "other"


def kind_of(data_type: T.DataType) -> str:
    """Family of a Spark type: numeric, temporal, boolean, categorical or other."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if is_point_in_time(data_type) or isinstance(
        data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType)
    ):
        return TEMPORAL
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return OTHER


def is_point_in_time(data_type: T.DataType) -> bool:
    """Dates, timestamps and times of day; intervals are temporal but not points."""
    return isinstance(
        data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)
    ) or data_type.typeName().startswith("time")


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType))


def is_floating(data_type: T.DataType) -> bool:
    """Types that can hold NaN and infinities."""
    return isinstance(data_type, (T.FloatType, T.DoubleType))
