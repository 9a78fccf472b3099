"""The profile of a table: per-column statistics, histograms, frequent values, correlations."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tablewright.functions.kinds import BOOLEAN, CATEGORICAL, NUMERIC, TEMPORAL, kind_of
from tablewright.functions.staging import stage
from tablewright.operators.correlation import correlation_pairs
from tablewright.operators.histograms import histogram_counts
from tablewright.operators.quantiles import quantiles
from tablewright.operators.scalars import distinct_counts, scalar_statistics
from tablewright.operators.top_values import top_value_counts
from tablewright.plans.options import ProfileOptions

STATS_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_fraction", T.DoubleType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("distinct_exact", T.BooleanType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("stddev", T.DoubleType()),
        T.StructField("p25", T.DoubleType()),
        T.StructField("p50", T.DoubleType()),
        T.StructField("p75", T.DoubleType()),
        # ISO text for temporal columns, all digits of whole numbers.
        T.StructField("min_text", T.StringType()),
        T.StructField("max_text", T.StringType()),
        T.StructField("true_count", T.LongType()),
        T.StructField("false_count", T.LongType()),
    ]
)


OPTIONAL_STATISTICS = ("distinct", "quartiles")


class Profile:
    """A profiled table. The frames hold aggregates only, never rows of the table.

    Each part runs its own jobs when it is first asked for and keeps what it found: the scalars are
    one scan, the distinct counts one, the quartiles one or, in large tables, a few. Histograms and
    correlations need the scalars; frequent values need nothing else.
    """

    def __init__(self, df: DataFrame, options: ProfileOptions = ProfileOptions()):
        self.df = df
        self.options = options
        self.fields = df.schema.fields[: options.max_columns]
        self.column_count = len(df.columns)

    @cached_property
    def _scalars(self) -> tuple[int, list[dict]]:
        return scalar_statistics(self.df, self.fields)

    @property
    def row_count(self) -> int:
        return self._scalars[0]

    @property
    def statistics(self) -> list[dict]:
        return self._scalars[1]

    @property
    def distinct_exact(self) -> bool:
        """Whether the distinct counts are exact and not HyperLogLog estimates."""
        return not self.options.approximate_distinct

    @cached_property
    def _distinct(self) -> dict[int, int]:
        if not self.row_count:
            return {}
        counts = distinct_counts(self.df, self.fields, self.distinct_exact)
        return {r["position"]: r["distinct_count"] for r in counts.collect()}

    @cached_property
    def _quartiles(self) -> dict[str, list]:
        return quantiles(self.df, self.numeric)

    def _names(self, kind: str) -> list[str]:
        return [f.name for f in self.fields if kind_of(f.dataType) == kind]

    @property
    def truncated(self) -> dict[str, bool]:
        numeric, text = len(self._names(NUMERIC)), len(self._names(CATEGORICAL))
        limits = self.options

        def beyond(count: int, limit: int | None) -> bool:
            return limit is not None and count > limit

        return {
            "columns": beyond(self.column_count, limits.max_columns),
            "histograms": beyond(numeric, limits.max_histograms),
            "top_values": beyond(text, limits.max_categorical),
            "correlations": beyond(numeric, limits.max_correlations),
        }

    @property
    def numeric(self) -> list[dict]:
        return [s for s in self.statistics if kind_of(s["field"].dataType) == NUMERIC]

    @property
    def categorical(self) -> list[str]:
        return self._names(CATEGORICAL)

    def columns(self, statistics: Iterable[str] = OPTIONAL_STATISTICS) -> DataFrame:
        """One row per profiled column, in schema order.

        Counts, ranges, mean and deviation are one scan and always there. Of the `statistics` that
        take jobs of their own, "distinct" and "quartiles", those not asked for are null.
        """
        wanted = set(statistics)
        if not wanted <= set(OPTIONAL_STATISTICS):
            raise ValueError(f"statistics are {OPTIONAL_STATISTICS}, not {sorted(wanted)}")
        rows = [self._column_row(position, s, wanted) for position, s in enumerate(self.statistics)]
        return self.df.sparkSession.createDataFrame(rows, STATS_SCHEMA)

    def _column_row(self, position: int, s: dict, wanted: Iterable[str] = OPTIONAL_STATISTICS) -> tuple:
        kind = kind_of(s["field"].dataType)
        ranged = kind in (NUMERIC, TEMPORAL)
        low, high = (json_value(s[key]) if ranged else None for key in ("min", "max"))
        numeric = kind == NUMERIC
        name = s["field"].name
        return (
            position,
            name,
            s["field"].dataType.simpleString(),
            kind,
            self.row_count,
            s["nulls"],
            s["nulls"] / self.row_count if self.row_count else 0.0,
            self._distinct.get(position, 0) if "distinct" in wanted else None,
            self.distinct_exact if "distinct" in wanted else None,
            float(low) if numeric and low is not None else None,
            float(high) if numeric and high is not None else None,
            json_value(s["mean"]) if numeric else None,
            json_value(s["stddev"]) if numeric else None,
            *(json_value(q) for q in (self._quartiles if "quartiles" in wanted else {}).get(name, [None] * 3)),
            str(low) if low is not None else None,
            str(high) if high is not None else None,
            s["true_count"] if kind == BOOLEAN else None,
            s["filled"] - s["true_count"] if kind == BOOLEAN else None,
        )

    def histograms(self) -> DataFrame:
        chosen = self.numeric[: self.options.max_histograms]
        return histogram_counts(self.df, chosen, self.options.bins)

    def top_values(self) -> DataFrame:
        chosen = self.categorical[: self.options.max_categorical]
        return top_value_counts(self.df, chosen, self.options.top_k)

    def correlations(self) -> DataFrame:
        """Long form of the symmetric matrix: row_name, column_name, r. Empty below two columns."""
        chosen = self.numeric[: self.options.max_correlations]
        spark = self.df.sparkSession
        schema = "row_name string, column_name string, r double"
        if len(chosen) < 2:
            return spark.createDataFrame([], schema)
        names = [s["field"].name for s in chosen]
        pairs = spark.createDataFrame(
            [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]],
            "row_name string, column_name string",
        )
        # A pair without a single common row yields no moments; it still has a cell.
        upper = pairs.join(correlation_pairs(self.df, chosen), ["row_name", "column_name"], "left")
        both = F.array(
            F.struct("row_name", "column_name", "r"),
            F.struct(
                F.col("column_name").alias("row_name"), F.col("row_name").alias("column_name"), "r"
            ),
        )
        diagonal = spark.createDataFrame([(n, n, 1.0) for n in names], schema)
        return upper.select(F.inline(both)).unionByName(diagonal)

    def summary(self) -> dict:
        """The whole profile as one JSON-ready document, of a size that columns and bins bound."""
        histograms: dict[str, list] = {}
        for h in self.histograms().orderBy("column", "bin").collect():
            histograms.setdefault(h["column"], []).append(
                {"bin_start": h["bin_start"], "bin_end": h["bin_end"], "count": h["count"]}
            )
        tops: dict[str, list] = {}
        for t in self.top_values().orderBy("column", "rank").collect():
            tops.setdefault(t["column"], []).append({"value": t["value"], "count": t["count"]})

        columns = []
        with_histogram = {s["field"].name for s in self.numeric[: self.options.max_histograms]}
        with_tops = set(self.categorical[: self.options.max_categorical])
        for position, s in enumerate(self.statistics):
            row = dict(zip(STATS_SCHEMA.names, self._column_row(position, s), strict=True))
            name, kind = row["name"], row["kind"]
            shown = ["name", "dtype", "kind", "null_count", "null_fraction", "distinct_count"]
            if kind == NUMERIC:
                shown += ["min", "max", "mean", "stddev", "p25", "p50", "p75"]
            elif kind == BOOLEAN:
                shown += ["true_count", "false_count"]
            entry = {key: row[key] for key in shown}
            if kind in (NUMERIC, TEMPORAL):
                entry |= {"min": json_value(s["min"]), "max": json_value(s["max"])}
            if name in with_histogram and s["finite"]:
                entry["histogram"] = histograms[name]
            if name in with_tops:
                entry["top_values"] = tops.get(name, [])
            columns.append(entry)

        return {
            "row_count": self.row_count,
            "column_count": self.column_count,
            "columns": columns,
            "correlations": self._matrix(),
            "distinct_exact": self.distinct_exact,
            "truncated": self.truncated,
        }

    def _matrix(self) -> dict | None:
        names = [s["field"].name for s in self.numeric[: self.options.max_correlations]]
        if len(names) < 2:
            return None
        at = {(c["row_name"], c["column_name"]): c["r"] for c in self.correlations().collect()}
        return {"columns": names, "matrix": [[at[a, b] for b in names] for a in names]}

    def to_json(self) -> str:
        return json.dumps(self.summary(), allow_nan=False, ensure_ascii=False)


def profile(
    df: DataFrame, options: ProfileOptions = ProfileOptions(), staged: bool = False
) -> Profile:
    """Profile a table; see Profile for what runs when.

    `staged` writes the table once and profiles what was written. It pays where reading again is
    dear, as with CSV or a long plan; Parquet is read column by column as it is.
    """
    return Profile(stage(df) if staged else df, options)


def json_value(value):
    """A scalar statistic as JSON can carry it."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value
