"""Columns that predict the target too well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, col, comparable, hash128
from tablewright.functions.kinds import NUMERIC, kind_of
from tablewright.operators.correlation import correlations_with
from tablewright.plans.options import AuditOptions

CORRELATION = "correlation"
SEPARATION = "threshold_separation"
DEPENDENCY = "functional_dependency"


def class_ranges(train: DataFrame, features: list[T.StructField], target: str) -> DataFrame:
    """Rows (column, class, low, high): the range of each numeric feature in each target class."""
    cells = F.array(
        *[F.struct(F.lit(f.name).alias("column"), as_double(f.name).alias("x")) for f in features]
    )
    return (
        train.filter(col(target).isNotNull())
        .select(comparable(train.schema[target]).alias("class"), F.inline(cells))
        .filter("x IS NOT NULL")
        .groupBy("column", "class")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
    )


def separations(train: DataFrame, features: list[T.StructField], target: str) -> DataFrame:
    """Rows (column, separates): whether thresholds on the column alone reproduce the target.

    They do when the ranges of the classes, put in order, do not touch. Meant for a target of few
    classes: the window holds one row per class and column.
    """
    in_order = Window.partitionBy("column").orderBy("low", "high")
    apart = F.coalesce(F.col("previous") < F.col("low"), F.lit(True))
    broken = F.isnan("low") | F.isnan("high")
    return (
        class_ranges(train, features, target)
        .withColumn("previous", F.lag("high").over(in_order))
        .groupBy("column")
        .agg(((F.count(F.lit(1)) >= 2) & F.every(apart & ~broken)).alias("separates"))
    )


def purities(train: DataFrame, features: list[T.StructField], target: str) -> DataFrame:
    """Rows (column, values, purity, all_rows): the share of rows whose feature value has a single
    target, and the number of rows of the table.

    Rows without a feature value are left out; missing targets do not count as a target. Values
    and targets travel as 16-byte hashes, whatever their type and length, and the counts are
    combined before the shuffle, so a value that fills a third of the table is one row per task.
    """
    cells = [F.struct(F.lit(-1).alias("feature"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"))]
    for position, field in enumerate(features):
        h1, h2 = hash128([comparable(field)])
        cells.append(
            F.struct(
                F.when(col(field.name).isNotNull(), F.lit(position)).alias("feature"),
                h1.alias("h1"),
                h2.alias("h2"),
            )
        )
    t1, t2 = hash128([comparable(train.schema[target])])
    known = col(target).isNotNull()
    values = (
        train.select(
            F.when(known, t1).alias("t1"), F.when(known, t2).alias("t2"), F.inline(F.array(*cells))
        )
        .filter("feature IS NOT NULL")
        .groupBy("feature", "h1", "h2")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("t1").alias("min1"),
            F.max("t1").alias("max1"),
            F.min("t2").alias("min2"),
            F.max("t2").alias("max2"),
        )
    )
    # Null where no row of the value has a target.
    pure = (F.col("min1") == F.col("max1")) & (F.col("min2") == F.col("max2"))
    names = F.array(*[F.lit(f.name) for f in features])
    by_feature = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("values"),
        (F.sum(F.when(pure, F.col("rows")).otherwise(0)) / F.sum("rows")).alias("purity"),
        F.sum("rows").alias("rows"),
    )
    # One row per feature and one, numbered -1, that counts the rows of the table.
    all_rows = F.max(F.when(F.col("feature") == -1, F.col("rows"))).over(Window.partitionBy(F.lit(0)))
    return (
        by_feature.withColumn("all_rows", all_rows)
        .filter("feature >= 0")
        .select(names[F.col("feature")].alias("column"), "values", "purity", "all_rows")
    )


def audited_features(
    train: DataFrame, target: str, options: AuditOptions
) -> tuple[list[T.StructField], list[str]]:
    """The columns to look at, and the names of those that the caller's limit leaves out."""
    features = [f for f in train.schema.fields if f.name != target]
    limit = len(features) if options.max_features is None else options.max_features
    return features[:limit], [f.name for f in features[limit:]]


def separable(train: DataFrame, target: str, options: AuditOptions) -> bool:
    """Whether the target has so few classes that thresholds could tell them apart."""
    classes = train.select(comparable(train.schema[target]).alias("class")).filter("class IS NOT NULL")
    return 2 <= classes.distinct().limit(options.max_classes + 1).count() <= options.max_classes


def target_proxies(
    train: DataFrame,
    target: str,
    options: AuditOptions = AuditOptions(),
) -> DataFrame:
    """Rows (position, column, signal, value), one per suspicious column.

    The first signal that fires names the column: linear correlation with the target, perfect
    separation of its classes by thresholds, or the target being a function of the column. The
    first two are cheap; grouping by values is for the columns that they leave open.
    """
    features, _ = audited_features(train, target, options)
    place = {f.name: i for i, f in enumerate(features)}
    numeric = [f for f in features if kind_of(f.dataType) == NUMERIC]
    named: dict[str, tuple[str, float]] = {}
    # Each of these results has at most one row per feature.
    if numeric and kind_of(train.schema[target].dataType) == NUMERIC:
        linear = F.abs(F.col("r")) >= options.proxy_correlation
        for row in correlations_with(train, numeric, target).filter(linear).collect():
            named[row["column"]] = CORRELATION, round(abs(row["r"]), 4)
    numeric = [f for f in numeric if f.name not in named]
    if numeric and separable(train, target, options):
        for row in separations(train, numeric, target).filter("separates").collect():
            named[row["column"]] = SEPARATION, 1.0
    rest = [f for f in features if f.name not in named]
    if rest:
        dependent = (F.col("values") <= options.max_distinct_ratio * F.col("all_rows")) & (
            F.col("purity") >= options.dependency_purity
        )
        for row in purities(train, rest, target).filter(dependent).collect():
            named[row["column"]] = DEPENDENCY, round(row["purity"], 4)
    rows = sorted((place[name], name, *found) for name, found in named.items())
    return train.sparkSession.createDataFrame(
        rows, "position int, column string, signal string, value double"
    )
