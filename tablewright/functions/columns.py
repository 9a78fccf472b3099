"""Column expressions: quoting, finite values, ISO text, hashes that tell nulls apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession, types as T
from pyspark.sql import functions as F

from tablewright.functions.kinds import is_floating

INFINITY = float("inf")
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def quoted(name: str) -> str:
    """Back-ticked name, so that dots, spaces and quotes are plain characters."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def as_double(name: str) -> Column:
    return col(name).cast("double")


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities mean "not computable" in results, which is null."""
    return F.when(is_finite(value), value)


def finite_double(field: T.StructField) -> Column:
    """The column as double, with nulls for what a histogram cannot place."""
    value = as_double(field.name)
    return finite_or_null(value) if is_floating(field.dataType) else value


def iso_text(value: Column, data_type: T.DataType) -> Column:
    """ISO 8601 text of a temporal value; fractions only when there are any."""
    if not isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")
    offset = "xxx" if isinstance(data_type, T.TimestampType) else ""
    fraction = F.date_format(value, "SSSSSS")
    return F.when(
        fraction == "000000", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss" + offset)
    ).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + offset))


def ordinal(field: T.StructField) -> Column:
    """Whole numbers, dates and timestamps as a bigint of the same order: days or microseconds
    since 1970. Zone-less timestamps are taken apart unless the session runs in UTC, since a cast
    goes through the session zone and bends the order where its clocks change."""
    value = col(field.name)
    data_type = field.dataType
    if isinstance(data_type, T.DateType):
        return F.unix_date(value)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(data_type, T.TimestampNTZType):
        if SparkSession.active().conf.get("spark.sql.session.timeZone") in UTC_NAMES:
            return F.unix_micros(value.cast("timestamp"))
        days = F.unix_date(value.cast("date")).cast("bigint")
        minutes = F.hour(value) * 60 + F.minute(value)
        micros = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
        return (days * 1440 + minutes) * 60_000_000 + micros
    return value.cast("bigint")


def json_scalar(value: Column, data_type: T.DataType) -> Column:
    """A value as JSON can carry it: finite numbers, ISO text, hex bytes, nested JSON text."""
    if isinstance(data_type, T.DecimalType):
        return value.cast("double")
    if is_floating(data_type):
        return finite_or_null(value.cast("double"))
    if isinstance(data_type, (T.IntegralType, T.BooleanType, T.StringType)):
        return value
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return iso_text(value, data_type)


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be hashed, grouped and compared.

    Maps have no equality in Spark, and the hash functions skip nulls inside nested values, so
    nested types go through JSON text that keeps their nulls.
    """
    value = col(field.name)
    if isinstance(field.dataType, T.MapType):
        value = F.array_sort(F.map_entries(value))
    if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if field.dataType.typeName() == "variant":
        return F.to_json(value)
    return value


def hash128(values: Iterable[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a tuple of values.

    Sixteen bytes stand for a value of any width in a shuffle. `xxhash64` skips nulls, so each
    value is preceded by its null flag: (null, 'a') and ('a', null) stay apart.
    """
    parts = [part for value in values for part in (F.isnull(value), value)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def row_struct(fields: Iterable[T.StructField], value: Callable[[T.StructField], Column]) -> Column:
    """One struct of all values and their null flags, to be hashed as a whole.

    The hash of a struct is generated in small methods. That of many single columns is one method,
    soon too large for the JIT compiler.
    """
    parts = []
    for position, field in enumerate(fields):
        parts.append(col(field.name).isNull().alias(f"n{position}"))
        parts.append(value(field).alias(f"v{position}"))
    return F.struct(*parts)


def struct_hash128(name: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a struct column made by `row_struct`."""
    return F.xxhash64(F.lit(1), F.col(name)), F.xxhash64(F.lit(2), F.col(name))


def key_text(field: T.StructField) -> Column:
    """Text of a key column. Nulls get a text of their own, so they hash like any other key."""
    value = comparable(field).cast("string")
    return F.coalesce(value, F.lit("\u0000null"))
