"""Reading CSV and Parquet, describing a schema, writing split partitions."""

from __future__ import annotations

from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.functions.kinds import kind_of

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


class InputError(ValueError):
    """The input cannot be used: unknown extension, empty or unreadable."""


def format_of(path: str) -> str | None:
    """Format by extension, whatever its case; None if it is not a known one."""
    return FORMATS.get(PurePosixPath(path).suffix.lower())


def read(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    sep: str = ",",
    row_id: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read a CSV or Parquet dataset; unusable input fails here and not in a later job.

    Line breaks inside quoted CSV fields need `multi_line`, and then a file cannot be read in parts.

    With `row_id`, a column of that name holds the place of each row, file and row number within
    it. Only Parquet can tell it.
    """
    fmt = fmt or format_of(path)
    if fmt not in ("csv", "parquet"):
        raise InputError(f"unsupported extension in '{path}', expected .csv or .parquet")
    if row_id and fmt != "parquet":
        raise InputError("only Parquet files tell the row number within a file")
    if not path_exists(spark, path):
        raise InputError(f"'{path}' does not exist")
    if path_size(spark, path) == 0:
        raise InputError(f"'{path}' is empty")
    try:
        if fmt == "csv":
            return _read_csv(spark, path, sep, multi_line)
        df = spark.read.parquet(path)
        if row_id:
            place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
            df = df.select("*", place.alias(row_id))
        return df
    except (PySparkException, Py4JJavaError) as error:
        raise InputError(f"could not read '{path}' as {fmt}: {error}") from error


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    location, files = _location(spark, path)
    return files.exists(location)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes under a path, as the file system reports them."""
    location, files = _location(spark, path)
    return files.getContentSummary(location).getLength()


def _read_csv(spark: SparkSession, path: str, sep: str, multi_line: bool) -> DataFrame:
    """Types come from every line of the file; a first guess from a sample could fail later."""
    options = {
        "header": True,
        "sep": sep,
        "escape": '"',
        "multiLine": multi_line,
        "mode": "FAILFAST",
        "enforceSchema": False,
    }
    guessed = spark.read.options(**options, inferSchema=True, samplingRatio=1.0).csv(path)
    if not guessed.columns:
        raise InputError(f"'{path}' has no columns")
    widened = T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in guessed.schema])
    return spark.read.options(**options).schema(widened).csv(path)


def _widened(data_type: T.DataType) -> T.DataType:
    """Whole numbers as bigint, and CSV timestamps without a zone: the text names none."""
    if isinstance(data_type, T.IntegralType):
        return T.LongType()
    if isinstance(data_type, T.TimestampType):
        return T.TimestampNTZType()
    return data_type


def schema_report(df: DataFrame, max_counted: int | None = None) -> DataFrame:
    """Rows (position, name, dtype, kind, row_count, null_count), one per column.

    Nulls are counted in one scan, for all columns or the first `max_counted`; beyond those the
    count is null while name and type are always there.
    """
    fields = df.schema.fields
    counted = fields if max_counted is None else fields[:max_counted]
    # The count of a column is never null, so nulls mark the columns left out.
    totals = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *[F.count(F.lit(1)) - F.count(col(f.name)) for f in counted],
            *[F.lit(None).cast("bigint")] * (len(fields) - len(counted)),
        ).alias("nulls"),
    )
    described = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(kind_of(f.dataType)).alias("kind"),
            )
            for position, f in enumerate(fields)
        ]
    )
    return totals.select(
        "row_count", F.inline(F.arrays_zip(described.alias("column"), F.col("nulls").alias("null_count")))
    ).select("column.*", "row_count", "null_count")
