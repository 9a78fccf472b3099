"""What two partitions share: rows, nearly equal rows, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import col, comparable, row_struct, struct_hash128
from tablewright.functions.kinds import OTHER, is_floating, is_fractional, kind_of

TRAIN, TEST = 1, 2

EXACT = "exact"
ROUNDED = "rounded"
GROUPS = "groups"


def rounded(field: T.StructField, decimals: int) -> Column:
    """The column with its fraction rounded half away from zero; whole numbers are as they are."""
    value = col(field.name)
    if isinstance(field.dataType, T.DecimalType):
        return F.round(value, decimals)
    if not is_floating(field.dataType):
        return comparable(field)
    double = value.cast("double")
    scale = float(10**decimals)
    scaled = F.abs(double) * scale
    whole = F.floor(scaled)
    up = F.when(scaled - whole >= 0.5, 1).otherwise(0)
    # Beyond this size a double has no fraction left to round. `round` would go through decimals.
    has_fraction = scaled < F.lit(2.0**53)
    return F.when(has_fraction, F.signum(double) * ((whole + up) / scale)).otherwise(double)


def aligned(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of train, in types that hold the values of both.

    The same number hashes differently as an int and as a bigint, so equal rows of re-read or
    widened tables would look different. Columns of which only one side has, or of which the types
    are of different families, make the sides incomparable.
    """
    if set(train.columns) != set(test.columns):
        apart = sorted(set(train.columns) ^ set(test.columns))
        raise ValueError(f"train and test do not have the same columns: {', '.join(apart)}")
    if all(f.dataType == test.schema[f.name].dataType for f in train.schema):
        return train, test.select(*[col(c) for c in train.columns])
    common = []
    for field in train.schema:
        ours, theirs = field.dataType, test.schema[field.name].dataType
        if ours == theirs:
            common.append(col(field.name))
            continue
        if kind_of(ours) != kind_of(theirs) or kind_of(ours) == OTHER:
            raise ValueError(
                f"column '{field.name}' is {ours.simpleString()} in train and "
                f"{theirs.simpleString()} in test"
            )
        nothing = F.coalesce(F.lit(None).cast(ours), F.lit(None).cast(theirs))
        wide = train.sparkSession.range(0).select(nothing.alias("v")).schema["v"].dataType
        common.append(col(field.name).cast(wide).alias(field.name))
    return train.select(*common), test.select(*common)


def shared_counts(
    train: DataFrame,
    test: DataFrame,
    decimals: int,
    group_column: str | None = None,
) -> dict[str, int]:
    """Distinct rows, distinct rows after rounding and distinct groups found on both sides.

    One job reads both sides once. Each row sends a 16-byte hash per question, tagged with its
    side and combined before the shuffle: copies of a row cost one record per task, and neither
    side is ever shuffled whole, as `intersect` would. Columns of different types are widened.
    """
    train, test = aligned(train, test)
    fields = train.schema.fields
    questions = {EXACT: row_struct(fields, comparable)}
    if any(is_fractional(f.dataType) for f in fields):
        questions[ROUNDED] = row_struct(fields, lambda f: rounded(f, decimals))
    if group_column:
        questions[GROUPS] = row_struct([train.schema[group_column]], comparable)

    cells = []
    for number, question in enumerate(questions):
        h1, h2 = struct_hash128(question)
        cells.append(F.struct(F.lit(number).alias("question"), h1.alias("h1"), h2.alias("h2")))

    def keys(side: DataFrame, tag: int) -> DataFrame:
        rows = side.select(*[row.alias(question) for question, row in questions.items()])
        return rows.select(F.lit(tag).alias("side"), F.inline(F.array(*cells)))

    shared = (
        keys(train, TRAIN)
        .unionByName(keys(test, TEST))
        .groupBy("question", "h1", "h2")
        .agg(F.bit_or("side").alias("sides"))
        .filter(F.col("sides") == (TRAIN | TEST))
        .groupBy("question")
        .count()
    )
    found = {r["question"]: r["count"] for r in shared.collect()}
    counts = {question: found.get(number, 0) for number, question in enumerate(questions)}
    counts.setdefault(ROUNDED, counts[EXACT])
    return counts
