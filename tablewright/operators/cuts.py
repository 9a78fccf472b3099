"""Exact cuts of a table by rank, found without ranking it.

A split needs to know for each row whether its rank is at most some edge. Ranking every row takes a
global sort; finding the key of the row *at* the edge takes a few small aggregations, and with it
the assignment is a comparison per row: no shuffle, no join, and a lost task recomputes its own
rows.

Keys are md5 hex digests, so they spread evenly over their prefixes however skewed the data is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import col, ordinal
from tablewright.functions.kinds import is_floating
from tablewright.operators.selection import Extent, OrderStatistic, order_statistics
from tablewright.plans.split_plan import SplitError

# Hex digits by which a bucket of keys is divided further: 4096 parts.
DIGITS = 3
# A bucket of at most this many keys is sorted.
SORTED_KEYS = 100_000
DIGEST_LENGTH = 32
# Above every hex digest.
EVERY_KEY = "~"
# Bytes of text, and digits of a decimal, that fit a positive bigint.
TEXT_STEP = 7
DIGIT_STEP = 18


@dataclass(frozen=True)
class KeyCut:
    """Rows with `key <= last` are in, and there are `rows` of them."""

    last: str
    rows: int


@dataclass
class _Bucket:
    prefix: str
    before: int
    keys: int


def key_cuts(df: DataFrame, key: Column, edges: set[int], unique: bool) -> dict[int, KeyCut]:
    """For each edge, the longest run of lowest keys that holds at most that many rows.

    With unique keys it holds exactly the edge. Otherwise rows of one key stay together and the
    key that would cross the edge is left out.
    """
    cuts: dict[int, KeyCut] = {}
    buckets = {edge: _Bucket("", 0, SORTED_KEYS + 1) for edge in edges}
    length = 0
    # A prefix stays shorter than the keys, so that it sorts below every key of its bucket.
    while length + DIGITS < DIGEST_LENGTH and any(b.keys > SORTED_KEYS for b in buckets.values()):
        length += DIGITS
        open_edges = [e for e, b in buckets.items() if b.keys > SORTED_KEYS]
        keys = F.count(F.lit(1)) if unique else F.approx_count_distinct("key")
        # At most 4096 rows per edge, whatever the size of the table.
        parts = (
            _within(df, key, {buckets[e].prefix for e in open_edges})
            .groupBy(F.substring("key", 1, length).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("rows"), keys.alias("keys"))
            .orderBy("prefix")
            .collect()
        )
        for edge in open_edges:
            crossed = _crossing(parts, buckets[edge], edge)
            if isinstance(crossed, KeyCut):
                cuts[edge] = crossed
                del buckets[edge]
            else:
                buckets[edge] = crossed
    return cuts | _sorted_cuts(df, key, buckets)


def _within(df: DataFrame, key: Column, prefixes: set[str]) -> DataFrame:
    keys = df.select(key.alias("key"))
    if "" in prefixes:
        return keys
    return keys.filter(reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes]))


def _crossing(parts: list, bucket: _Bucket, edge: int) -> _Bucket | KeyCut:
    before = bucket.before
    for part in parts:
        if not part["prefix"].startswith(bucket.prefix):
            continue
        if before + part["rows"] > edge:
            return _Bucket(part["prefix"], before, part["keys"])
        before += part["rows"]
    return KeyCut(EVERY_KEY, before)


def _sorted_cuts(df: DataFrame, key: Column, buckets: dict[int, _Bucket]) -> dict[int, KeyCut]:
    if not buckets:
        return {}
    length_of = {b.prefix: len(b.prefix) for b in buckets.values()}
    prefix = F.coalesce(
        *[F.when(F.col("key").startswith(p), F.lit(p)) for p in sorted(length_of, key=len, reverse=True)]
    )
    in_order = Window.partitionBy("prefix").orderBy("key")
    running = (
        _within(df, key, set(length_of))
        .groupBy(prefix.alias("prefix"), "key")
        .count()
        .withColumn("upto", F.sum("count").over(in_order))
    )
    best = []
    for index, (edge, bucket) in enumerate(buckets.items()):
        held = (F.col("prefix") == F.lit(bucket.prefix)) & (F.col("upto") <= edge - bucket.before)
        best.append(F.max(F.when(held, F.struct("key", "upto"))).alias(f"e{index}"))
    row = running.agg(*best).first()
    cuts = {}
    for index, (edge, bucket) in enumerate(buckets.items()):
        hit = row[f"e{index}"]
        cuts[edge] = (
            KeyCut(hit["key"], bucket.before + hit["upto"])
            if hit
            else KeyCut(bucket.prefix, bucket.before)
        )
    return cuts


def exact_key_cuts(df: DataFrame, key: Column, edges: set[int]) -> dict[int, str]:
    """Last key of exactly the wanted number of rows; keys must tell rows apart."""
    cuts = key_cuts(df, key, edges, unique=True)
    for edge, cut in cuts.items():
        if cut.rows != edge:
            raise SplitError(
                f"no cut after exactly {edge} rows: several rows share one key, "
                "the id columns do not identify rows"
            )
    return {edge: cut.last for edge, cut in cuts.items()}


def value_cuts(
    df: DataFrame, field: T.StructField, key: Column, ranks: tuple[int, ...], rows: int
) -> list[Column]:
    """Per rank, a condition true for exactly that many of the `rows` rows: the first by value,
    nulls last, then by key. All ranks share the scans that find their values."""
    value = col(field.name)
    known = df.filter(value.isNotNull())
    level = next(_levels(field))
    span = df.agg(
        F.count(value).alias("filled"), F.min(level).alias("low"), F.max(level).alias("high")
    ).first()
    filled = span["filled"]
    found = order_statistics(
        known,
        {"v": level},
        {"v": Extent(span["low"], span["high"], filled)},
        {"v": {r for r in ranks if 0 < r <= filled and r < rows}},
    )

    def condition(rank: int) -> Column:
        if rank <= 0:
            return F.lit(False)
        if rank >= rows:
            return F.lit(True)
        if rank > filled:
            nulls = df.filter(value.isNull())
            last = exact_key_cuts(nulls, key, {rank - filled})[rank - filled]
            return value.isNotNull() | (key <= F.lit(last))
        return value.isNotNull() & _tied_cut(known, field, key, rank, found["v", rank])

    return [F.coalesce(condition(rank), F.lit(False)) for rank in ranks]


def _tied_cut(
    known: DataFrame, field: T.StructField, key: Column, rank: int, at: OrderStatistic
) -> Column:
    """The cut among the rows that tie on the first level: by further levels, then by key."""
    value = col(field.name)
    levels = _levels(field)
    if isinstance(field.dataType, (T.DecimalType, T.StringType)):
        order = value.cast("binary") if isinstance(field.dataType, T.StringType) else value
        return _ordered_cut(known, order, levels, key, rank, at)
    steps: list[tuple[Column, int | float]] = []
    level, tied, position = next(levels), known, rank
    while True:
        steps.append((level, at.value))
        tied = tied.filter(level == F.lit(at.value))
        position, size = position - at.below, at.equal
        level = next(levels, None)
        if level is None or position == size:
            break
        span = tied.agg(
            F.min(level).alias("low"),
            F.max(level).alias("high"),
            (F.min(value) == F.max(value)).alias("single"),
        ).first()
        if span["single"]:
            break
        extent = Extent(span["low"], span["high"], size)
        at = order_statistics(tied, {"v": level}, {"v": extent}, {"v": {position}})["v", position]

    inside = F.lit(True)
    if position < size:
        inside = key <= F.lit(exact_key_cuts(tied, key, {position})[position])
    for level, at_value in reversed(steps):
        inside = (level < F.lit(at_value)) | ((level == F.lit(at_value)) & inside)
    return inside


def _ordered_cut(
    known: DataFrame, order: Column, levels: Iterator[Column], key: Column, rank: int, at: OrderStatistic
) -> Column:
    """The same for values of many levels, compared as they are. Levels never fall as values rise, so
    the rows that tie lie between two values: no level is read again once it is settled."""
    level, tied, position = next(levels), known, rank
    while True:
        tied = tied.filter(level == F.lit(at.value))
        position, size = position - at.below, at.equal
        level = next(levels, level)
        span = tied.agg(
            F.min(order).alias("first"),
            F.max(order).alias("last"),
            F.min(level).alias("low"),
            F.max(level).alias("high"),
        ).first()
        first, last = F.lit(span["first"]), F.lit(span["last"])
        if position == size:
            return order <= last
        tied = known.filter(order.between(first, last))
        if span["first"] == span["last"]:
            cut = exact_key_cuts(tied, key, {position})[position]
            return (order < last) | ((order == last) & (key <= F.lit(cut)))
        extent = Extent(span["low"], span["high"], size)
        at = order_statistics(tied, {"v": level}, {"v": extent}, {"v": {position}})["v", position]


def _levels(field: T.StructField) -> Iterator[Column]:
    """Numbers that order like the column, most significant first.

    One is enough for whole numbers, points in time and intervals. Text is read seven bytes at a
    time, decimals eighteen digits, as long as the cut falls among values that agree so far.
    """
    data_type = field.dataType
    value = col(field.name)
    if is_floating(data_type):
        # Infinities at either end, NaN above everything.
        yield (
            F.when(F.isnan(value), F.lit(2))
            .when(value == float("inf"), F.lit(1))
            .when(value == float("-inf"), F.lit(-1))
            .otherwise(F.lit(0))
            .cast("bigint")
        )
        yield value.cast("double")
    elif isinstance(data_type, T.DecimalType):
        yield from _decimal_levels(value, data_type)
    elif isinstance(data_type, T.StringType):
        yield from _text_levels(value)
    elif isinstance(data_type, T.DayTimeIntervalType):
        whole = value.cast("interval day to second")
        day, hour, minute, second = (F.extract(F.lit(p), whole) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
        minutes = (day.cast("bigint") * 24 + hour) * 60 + minute
        yield minutes * 60_000_000 + (second * 1_000_000).cast("bigint")
    elif isinstance(data_type, T.YearMonthIntervalType):
        whole = value.cast("interval year to month")
        yield F.extract(F.lit("YEAR"), whole).cast("bigint") * 12 + F.extract(F.lit("MONTH"), whole)
    elif isinstance(data_type, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        yield ordinal(field).cast("bigint")
    elif isinstance(data_type, T.BooleanType):
        yield value.cast("int").cast("bigint")
    else:
        raise SplitError(f"'{field.name}' of type {data_type.simpleString()} cannot order rows")


def _text_levels(value: Column) -> Iterator[Column]:
    """Seven bytes of a text at a time, then how many of them it has: a text that ends comes before
    one that goes on, even with bytes of zero."""
    raw = value.cast("binary")
    start = 1
    while True:
        piece = F.substring(raw, start, TEXT_STEP)
        number = F.conv(F.rpad(F.hex(piece), 2 * TEXT_STEP, "0"), 16, 10).cast("bigint")
        yield number * (TEXT_STEP + 1) + F.octet_length(piece)
        start += TEXT_STEP


def _decimal_levels(value: Column, data_type: T.DecimalType) -> Iterator[Column]:
    """Eighteen digits at a time, each with the sign of the whole number."""
    width = -(-data_type.precision // DIGIT_STEP) * DIGIT_STEP
    digits = F.lpad(F.translate(value.cast("string"), "-.", ""), width, "0")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    for start in range(1, width, DIGIT_STEP):
        yield F.concat(sign, F.substring(digits, start, DIGIT_STEP)).cast("bigint")
