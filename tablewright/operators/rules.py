"""Quality rules: what must hold for rows, keys and references, and how many rows break it.

Rules on single rows are one aggregate with a count per rule. Keys, of uniqueness and of references to
other tables, are 16-byte hashes of one long table, grouped once for all rules: copies are combined
before the shuffle, so a key that fills a third of the table is a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, hash128

WARNING, CRITICAL = "warning", "critical"
SCHEMA = "position int, rule string, columns array<string>, severity string, rows bigint, failing bigint, passed boolean"


class RuleError(ValueError):
    """A rule that can't be asked of this table."""


@dataclass(frozen=True)
class NotNull:
    """No nulls in the column."""

    column: str
    severity: str = CRITICAL


@dataclass(frozen=True)
class Between:
    """Values lie in a closed range; None is no bound. Nulls pass, NaN is the largest value."""

    column: str
    low: Any = None
    high: Any = None
    severity: str = WARNING


@dataclass(frozen=True)
class OneOf:
    """Values are among some. Nulls pass."""

    column: str
    values: tuple
    severity: str = WARNING


@dataclass(frozen=True)
class Matches:
    """Texts hold a match of a regular expression. Nulls pass."""

    column: str
    pattern: str
    severity: str = WARNING


@dataclass(frozen=True)
class Holds:
    """An SQL condition over a row's columns is not false. Unknown passes."""

    condition: str
    severity: str = WARNING


@dataclass(frozen=True)
class Unique:
    """No two rows have the same values in the columns. Rows with a null among them pass."""

    columns: tuple[str, ...]
    severity: str = CRITICAL


@dataclass(frozen=True)
class References:
    """The values of the columns are those of a row of another table, of the same types. Rows with a null
    among them pass."""

    columns: tuple[str, ...]
    table: str
    key: tuple[str, ...]
    severity: str = CRITICAL


Rule = NotNull | Between | OneOf | Matches | Holds | Unique | References


def _broken(rule: Rule) -> Column:
    """Whether a row breaks a rule on single rows."""
    if isinstance(rule, NotNull):
        return col(rule.column).isNull()
    if isinstance(rule, Between):
        value = col(rule.column)
        low = value < F.lit(rule.low) if rule.low is not None else F.lit(False)
        return low | (value > F.lit(rule.high) if rule.high is not None else F.lit(False))
    if isinstance(rule, OneOf):
        return ~col(rule.column).isin(list(rule.values)) if rule.values else col(rule.column).isNotNull()
    if isinstance(rule, Matches):
        return ~col(rule.column).rlike(rule.pattern)
    return ~F.expr(rule.condition)


def _columns(rule: Rule) -> list[str]:
    if isinstance(rule, Holds):
        return []
    return [rule.column] if hasattr(rule, "column") else list(rule.columns)


def _key(names: tuple[str, ...]) -> Column:
    whole = reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names])
    return F.when(whole, F.struct(*hash128([col(n) for n in names])))


def check_rules(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per rule: how many rows break it. `Unique` counts every row of a key that occurs twice or
    more, `References` every row without a partner. An empty table passes all."""
    tables = tables or {}
    for rule in rules:
        missing = [c for c in _columns(rule) if c not in df.columns]
        if isinstance(rule, References):
            if rule.table not in tables or len(rule.key) != len(rule.columns):
                raise RuleError(f"no table '{rule.table}' with a key of {len(rule.columns)} columns")
            other = tables[rule.table]
            missing += [c for c in rule.key if c not in other.columns]
            kinds = [(df.schema[a].dataType, other.schema[b].dataType) for a, b in zip(rule.columns, rule.key) if not missing]
            if any(a != b for a, b in kinds):
                raise RuleError(f"the key of '{rule.table}' has other types than {', '.join(rule.columns)}")
        if missing:
            raise RuleError(f"columns that are not there: {', '.join(missing)}")
        if isinstance(rule, (Unique, References)) and not rule.columns:
            raise RuleError("a key has one column or more")
    of_rows = {i: r for i, r in enumerate(rules) if not isinstance(r, (Unique, References))}
    of_keys = {i: r for i, r in enumerate(rules) if isinstance(r, (Unique, References))}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(_broken(r)).alias(f"r{i}") for i, r in of_rows.items()]).first()
    failing = {i: counts[f"r{i}"] for i in of_rows}
    if of_keys:
        failing |= dict.fromkeys(of_keys, 0) | _broken_keys(df, of_keys, tables)
    rows = [
        (i, str(rule), _columns(rule), rule.severity, counts["rows"], failing[i], failing[i] == 0)
        for i, rule in enumerate(rules)
    ]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _broken_keys(df: DataFrame, rules: dict[int, Rule], tables: dict[str, DataFrame]) -> dict[int, int]:
    keys = F.array(*[F.struct(F.lit(i).alias("rule"), _key(r.columns).alias("key")) for i, r in rules.items()])
    sides = [df.select(F.inline(keys)).withColumn("own", F.lit(1))]
    for i, rule in rules.items():
        if isinstance(rule, References):
            there = tables[rule.table].select(F.lit(i).alias("rule"), _key(rule.key).alias("key"))
            sides.append(there.withColumn("own", F.lit(0)))
    long = reduce(DataFrame.unionByName, sides).filter("key IS NOT NULL")
    each = long.groupBy("rule", "key").agg(F.sum("own").alias("own"), F.count_if(F.col("own") == 0).alias("partners"))
    unique = F.col("rule").isin([i for i, r in rules.items() if isinstance(r, Unique)])
    broken = F.when(unique, F.col("own") > 1).otherwise(F.col("partners") == 0)
    found = each.filter(broken).groupBy("rule").agg(F.sum("own").alias("failing"))
    return {r.rule: r.failing for r in found.collect()}  # one row per rule
