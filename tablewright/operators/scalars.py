"""Scalar statistics of all columns.

The columns go to tasks as Arrow batches, where each is reduced to a few sums and bounds: one scan
at any width, without generated code per column. Only one row per task and column is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    as_double,
    col,
    comparable,
    hash128,
    iso_text,
    ordinal,
)
from tablewright.functions.kinds import BOOLEAN, NUMERIC, TEMPORAL, is_floating, kind_of

# Relative standard deviation of the HyperLogLog estimates.
DISTINCT_ERROR = 0.02

MEASURES = (
    "filled",
    "true_count",
    "first",
    "last",
    "mean",
    "stddev",
    "finite",
    "low",
    "high",
    "below_finite",
)

# Of one task and column; `sum`, `centre` and `spread` are null without numbers.
PARTS = (
    "position int, rows bigint, filled bigint, true_count bigint, first bigint, last bigint, sum double, "
    "centre double, spread double, finite bigint, low double, high double, below_finite bigint"
)

ORDINAL_TYPES = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _cell(field: T.StructField) -> Column:
    """What the measures of a column need: its numbers, its truth, or only whether it is there."""
    if isinstance(field.dataType, ORDINAL_TYPES):
        return ordinal(field).cast("bigint")
    if kind_of(field.dataType) == NUMERIC:
        return as_double(field.name)
    there = col(field.name).isNotNull()
    return col(field.name) if kind_of(field.dataType) == BOOLEAN else F.when(there, F.lit(False))


def _column_parts(numeric: list[bool]):
    """The per-task reduction; `numeric` columns have sums. A nested function travels by value."""
    names = [part.split()[0] for part in PARTS.split(", ")]

    def of_batch(column: pa.Array, summed: bool) -> dict:
        part = dict.fromkeys(names) | {"rows": len(column), "true_count": 0, "finite": 0, "below_finite": 0}
        part["filled"] = len(column) - column.null_count
        values = column.drop_null() if column.null_count else column
        if pa.types.is_boolean(column.type):
            part["true_count"] = values.true_count
            return part
        values = values.to_numpy(zero_copy_only=False)
        if not len(values):
            return part
        if values.dtype.kind == "i":
            part["first"], part["last"] = int(values.min()), int(values.max())
        if not summed:
            return part
        numbers = values.astype(np.float64, copy=False)
        with np.errstate(all="ignore"):
            part["sum"] = float(numbers.sum())
            part["centre"] = part["sum"] / len(numbers)
            off = numbers - part["centre"]
            part["spread"] = float((off * off).sum())
        low, high = float(numbers.min()), float(numbers.max())
        if not (np.isfinite(low) and np.isfinite(high)):  # a NaN is the least and the greatest here
            part["below_finite"] = int((numbers == -np.inf).sum())
            numbers = numbers[np.isfinite(numbers)]
            low, high = (float(numbers.min()), float(numbers.max())) if len(numbers) else (None, None)
        part["finite"], part["low"], part["high"] = len(numbers), low, high
        return part

    def merged(p: dict, q: dict) -> dict:
        out = {n: p[n] + q[n] for n in ("rows", "filled", "true_count", "finite", "below_finite")}
        for n, pick in (("first", min), ("last", max), ("low", min), ("high", max)):
            out[n] = q[n] if p[n] is None else p[n] if q[n] is None else pick(p[n], q[n])
        if p["sum"] is None or q["sum"] is None:
            return out | {n: q[n] if p["sum"] is None else p[n] for n in ("sum", "centre", "spread")}
        n, between = out["filled"], q["centre"] - p["centre"]
        out["sum"] = p["sum"] + q["sum"]
        out["centre"] = p["centre"] + between * (q["filled"] / n)
        out["spread"] = p["spread"] + q["spread"] + between * between * (p["filled"] * (q["filled"] / n))
        return out

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if batch.num_rows:
                found = [of_batch(c, numbers) for c, numbers in zip(batch.columns, numeric)]
                totals = found if totals is None else [merged(p, q) for p, q in zip(totals, found)]
        if totals is None:
            return
        types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
        arrays = []
        for part in PARTS.split(", "):
            name, kind = part.split()
            cells = range(len(totals)) if name == "position" else [t[name] for t in totals]
            arrays.append(pa.array(cells, types[kind]))
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return reduce_batches


def scalar_statistics(df: DataFrame, fields: list[T.StructField]) -> tuple[int, list[dict]]:
    """Row count and, per field, its scalar statistics; one row per field reaches the driver."""
    if not fields:
        return df.count(), []
    cells = [_cell(f).alias(f"c{i}") for i, f in enumerate(fields)]
    numeric = [kind_of(f.dataType) == NUMERIC for f in fields]
    parts = df.select(*cells).mapInArrow(_column_parts(numeric), PARTS)
    # Deviations of a task's mean from the common one are summed up, as for correlations.
    column = Window.partitionBy("position")
    known = F.when(F.col("sum").isNotNull(), F.col("filled"))
    parts = parts.withColumn("mean", F.sum("sum").over(column) / F.sum(known).over(column))
    off = F.col("centre") - F.col("mean")
    spread = F.sum(F.col("spread") + F.col("filled") * off * off)
    found = parts.groupBy("position").agg(
        *[F.sum(n).alias(n) for n in ("rows", "filled", "true_count", "finite", "below_finite")],
        *[F.min(n).alias(n) for n in ("first", "low", "mean")],
        *[F.max(n).alias(n) for n in ("last", "high")],
        F.when(F.sum(known) > 1, F.sqrt(spread / (F.sum(known) - 1))).alias("stddev"),
    )
    by_position = {r["position"]: r.asDict() for r in found.collect()}
    rows = by_position[0]["rows"] if by_position else 0
    empty = dict.fromkeys(("rows", *MEASURES)) | dict.fromkeys(
        ("rows", "filled", "true_count", "finite", "below_finite"), 0
    )
    other_ranges = _other_ranges(df, fields)
    statistics = []
    for position, field in enumerate(fields):
        s = by_position.get(position, empty) | {"field": field}
        s["nulls"] = rows - s["filled"]
        s["min"], s["max"] = _range(s) if field.name not in other_ranges else other_ranges[field.name]
        statistics.append(s)
    return rows, statistics


def _range(s: dict) -> tuple:
    """Smallest and largest value as the result shows them.

    A NaN is the largest value there is and cannot be shown, so it leaves no maximum; infinities
    likewise.
    """
    data_type = s["field"].dataType
    if isinstance(data_type, T.IntegralType):
        return s["first"], s["last"]
    if isinstance(data_type, ORDINAL_TYPES):
        return tuple(_iso(v, data_type) for v in (s["first"], s["last"]))
    above_finite = s["filled"] - s["finite"] - s["below_finite"]
    return (
        None if s["below_finite"] else s["low"],
        None if above_finite else s["high"],
    )


def _iso(value: int | None, data_type: T.DataType) -> str | None:
    if value is None:
        return None
    if isinstance(data_type, T.DateType):
        return (date(1970, 1, 1) + timedelta(days=value)).isoformat()
    zone = UTC if isinstance(data_type, T.TimestampType) else None
    return (datetime(1970, 1, 1, tzinfo=zone) + timedelta(microseconds=value)).isoformat()


def _other_ranges(df: DataFrame, fields: list[T.StructField]) -> dict[str, tuple]:
    """Ranges of the temporal columns that are no dates or timestamps: intervals, times of day."""
    others = [
        f for f in fields if kind_of(f.dataType) == TEMPORAL and not isinstance(f.dataType, ORDINAL_TYPES)
    ]
    if not others:
        return {}
    row = df.agg(
        *[iso_text(g(col(f.name)), f.dataType).alias(f"{i}{g.__name__}")
          for i, f in enumerate(others) for g in (F.min, F.max)]
    ).first()
    return {f.name: (row[2 * i], row[2 * i + 1]) for i, f in enumerate(others)}


def distinct_counts(df: DataFrame, fields: list[T.StructField], exact: bool) -> DataFrame:
    """Distinct values per field (position, distinct_count), nulls left out.

    Exact: one shuffle for all columns together, combined before it: of whole numbers, dates and
    timestamps as words of 64 bits, a bit for each number that is there; of fractions as 8-byte
    hashes, which are one to one; of anything else as 16-byte hashes. `count_distinct` on every
    column would shuffle rows as wide as the table, once per column.
    Estimated: one HyperLogLog sketch per column and task.
    """
    if not exact:
        hashes = [F.when(col(f.name).isNotNull(), F.xxhash64(comparable(f))) for f in fields]
        keys = df.select(F.posexplode(F.array(*hashes)).alias("position", "hash"))
        estimate = F.approx_count_distinct("hash", DISTINCT_ERROR)
        return (
            keys.filter("hash IS NOT NULL")
            .groupBy("position")
            .agg(estimate.alias("distinct_count"))
        )

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    cells = []
    for position, field in enumerate(fields):
        if isinstance(field.dataType, ORDINAL_TYPES):
            number = ordinal(field).cast("bigint")
            h1, h2 = F.shiftright(number, 6), zero
            bits = F.call_function("shiftleft", one, number.bitwiseAND(F.lit(63)).cast("int"))
        elif is_floating(field.dataType):
            h1, h2, bits = F.xxhash64(col(field.name)), zero, one
        else:
            (h1, h2), bits = hash128([comparable(field)]), one
        cells.append(
            F.struct(
                F.when(col(field.name).isNotNull(), F.lit(position)).alias("position"),
                h1.alias("h1"),
                h2.alias("h2"),
                bits.alias("bits"),
            )
        )
    return (
        df.select(F.inline(F.array(*cells)))
        .filter("position IS NOT NULL")
        .groupBy("position", "h1", "h2")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy("position")
        .agg(F.sum(F.bit_count("bits")).alias("distinct_count"))
    )
