"""Exact order statistics without sorting the data.

Quantiles and split cuts both ask for the r-th smallest value of a column. A global sort or a
window without partitions answers that in one task; here each round is one map-side-combined
aggregation that counts rows in equal-width buckets of a bracket known to hold the answer, and the
bracket shrinks to one bucket. Once a bracket holds few rows, its values are counted one by one.
All columns and all ranks share the rounds.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
# Brackets of at most this many rows are resolved value by value.
DIRECT_ROWS = 100_000
SMALLEST_WIDTH = 5e-324


@dataclass(frozen=True)
class OrderStatistic:
    """The value at a rank, how many rows lie below it and how many are equal to it."""

    value: float | int
    below: int
    equal: int


@dataclass(frozen=True)
class Bracket:
    name: str
    low: float | int
    high: float | int
    below: int
    rows: int


@dataclass(frozen=True)
class Extent:
    """Smallest and largest value of a column and its number of rows, nulls left out."""

    low: float | int
    high: float | int
    rows: int


def order_statistics(
    df: DataFrame,
    values: dict[str, Column],
    extents: dict[str, Extent],
    ranks: dict[str, set[int]],
    direct_rows: int = DIRECT_ROWS,
) -> dict[tuple[str, int], OrderStatistic]:
    """Value at each 1-based rank of each column.

    `values` are all doubles without NaN or infinities, or all longs; nulls are left out.
    """
    found: dict[tuple[str, int], OrderStatistic] = {}
    open_brackets: dict[Bracket, set[int]] = {}

    def settle(bracket: Bracket, wanted: set[int]) -> None:
        if bracket.low == bracket.high:
            for rank in wanted:
                found[bracket.name, rank] = OrderStatistic(
                    bracket.low, bracket.below, bracket.rows
                )
        elif wanted:
            open_brackets[bracket] = wanted

    for name, wanted in ranks.items():
        extent = extents[name]
        settle(Bracket(name, extent.low, extent.high, 0, extent.rows), set(wanted))

    while open_brackets:
        wide = {b: w for b, w in open_brackets.items() if b.rows > direct_rows}
        brackets = wide or dict(open_brackets)
        for bracket in brackets:
            del open_brackets[bracket]
        inside = _inside(df, values, list(brackets))
        counts = _bucket_counts(inside) if wide else _value_counts(inside)
        narrowed: dict[Bracket, set[int]] = defaultdict(set)
        for bracket, rank in _picks(counts, brackets):
            narrowed[bracket].add(rank)
        for bracket, wanted in narrowed.items():
            settle(bracket, wanted)
    return found


def _inside(df: DataFrame, values: dict[str, Column], brackets: list[Bracket]) -> DataFrame:
    """Rows (value, bracket), one per value and bracket that holds it.

    The brackets of a column are looked up by its position in one constant, so the generated code
    is the same for two columns as for two hundred.
    """
    names = list(dict.fromkeys(b.name for b in brackets))
    table = [
        [
            {"index": i, "low": b.low, "high": b.high, "width": _width(b)}
            for i, b in enumerate(brackets)
            if b.name == name
        ]
        for name in names
    ]
    kind = "bigint" if isinstance(brackets[0].low, int) else "double"
    schema = f"array<array<struct<index:int,low:{kind},high:{kind},width:double>>>"
    lookup = F.from_json(F.lit(json.dumps(table)), schema)
    held = F.filter(
        lookup[F.col("column")], lambda b: F.col("value").between(b["low"], b["high"])
    )
    return (
        df.select(F.posexplode(F.array(*[values[n] for n in names])).alias("column", "value"))
        .filter("value IS NOT NULL")
        .select("value", F.explode(held).alias("bracket"))
    )


def _width(bracket: Bracket) -> float:
    if isinstance(bracket.low, int):
        width = (bracket.high - bracket.low) / BUCKETS
    else:
        width = bracket.high / BUCKETS - bracket.low / BUCKETS
    return max(width, SMALLEST_WIDTH)


def _bucket_counts(inside: DataFrame) -> DataFrame:
    """Rows (bracket, rows, low, high), one per bucket that holds anything.

    The bucket number grows with the value; the lowest value of a bracket is in the first bucket
    and the highest in the last.
    """
    # Of two values with one sign the difference is exact; that of others may overflow, but is large.
    offset = F.expr(
        "CASE WHEN (value < 0) = (bracket.low < 0) THEN cast(value - bracket.low AS double) "
        "ELSE cast(value AS double) - cast(bracket.low AS double) END / bracket.width"
    )
    bucket = F.floor(F.least(offset, F.lit(float(BUCKETS - 1)))).cast("int")
    return (
        inside.groupBy((F.col("bracket.index") * BUCKETS + bucket).alias("code"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .withColumn("bracket", F.expr(f"cast(code div {BUCKETS} AS int)"))
    )


def _value_counts(inside: DataFrame) -> DataFrame:
    """Rows (bracket, rows, low, high), one per distinct value; low and high are that value."""
    return (
        inside.groupBy(F.col("bracket.index").alias("bracket"), F.col("value").alias("low"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("high", F.col("low"))
    )


def _picks(counts: DataFrame, brackets: dict[Bracket, set[int]]) -> list[tuple[Bracket, int]]:
    """The narrower bracket in which each wanted rank falls."""
    ordered = list(brackets)
    # A window group holds at most BUCKETS rows, or the distinct values of direct_rows rows.
    running = (
        Window.partitionBy("bracket")
        .orderBy("low")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    targets = counts.sparkSession.createDataFrame(
        [
            (index, rank, rank - bracket.below)
            for index, bracket in enumerate(ordered)
            for rank in sorted(brackets[bracket])
        ],
        "bracket int, rank long, position long",
    )
    picks = (
        counts.withColumn("upto", F.sum("rows").over(running))
        .join(F.broadcast(targets), "bracket")
        .filter("upto - rows < position AND position <= upto")
        .withColumn("before", F.col("upto") - F.col("rows"))
        .collect()  # one row per wanted rank
    )
    return [
        (
            Bracket(
                ordered[p["bracket"]].name,
                p["low"],
                p["high"],
                ordered[p["bracket"]].below + p["before"],
                p["rows"],
            ),
            p["rank"],
        )
        for p in picks
    ]


def interpolate(fraction: float, lower: float, upper: float) -> float:
    return lower + (upper - lower) * fraction
