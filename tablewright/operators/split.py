"""Splitting a table into train, validation and test with exact sizes and a fixed seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    col,
    comparable,
    hash128,
    key_text,
    row_struct,
    struct_hash128,
)
from tablewright.functions.staging import stage
from tablewright.operators.cuts import exact_key_cuts, key_cuts, value_cuts
from tablewright.plans.split_plan import (
    GROUP,
    SPLIT_NAMES,
    STRATIFIED,
    TIME_BASED,
    SplitError,
    SplitPlan,
)
from tablewright.sources.tables import format_of, path_exists, read

SPLIT_COLUMN = "tw_split"
KEY = "tw_key"
ROW_ID = "tw_row_id"
HELPERS = (
    KEY,
    "tw_h1",
    "tw_h2",
    "tw_part",
    "tw_row",
    "tw_before",
    "tw_copy",
    "tw_rank",
    "tw_size",
    "tw_cut_train",
    "tw_cut_val",
)
SEPARATOR = "\u001f"

# At most this many strata can each hold more than one part in HEAVY_STRATA of the rows. They get
# their cut from a table of that size; a stratum below it is small enough for one window group.
HEAVY_STRATA = 100_000
# Up to so many contents of 16 bytes are sent to every executor.
BROADCAST_CONTENTS = 500_000


def assign(df: DataFrame, plan: SplitPlan, id_columns: list[str] | None = None) -> DataFrame:
    """The table with a `tw_split` column: train, val or test.

    `id_columns` identify a row and make its draw depend on nothing else, at no extra cost. Without
    them the draw depends on the content of the row, and rows with equal content are numbered
    first, which takes a shuffle of the whole table.
    """
    plan.validate(df.columns)
    clash = {SPLIT_COLUMN, *HELPERS} & set(df.columns)
    if clash:
        raise SplitError(f"reserved column names in the dataset: {sorted(clash)}")
    missing = set(id_columns or ()) - set(df.columns)
    if missing:
        raise SplitError(f"id columns do not exist in the dataset: {sorted(missing)}")

    columns = df.columns
    if plan.strategy == GROUP:
        assigned = _by_group(df, plan)
    else:
        df, key = _row_key(df, plan, id_columns)
        if plan.strategy == STRATIFIED:
            assigned = _stratified(df, plan, key)
        elif plan.strategy == TIME_BASED:
            assigned = _by_time(df, plan, key)
        else:
            assigned = _random(df, plan, key)
    return assigned.select(*[col(c) for c in columns], SPLIT_COLUMN)


def _named(in_train: Column, in_val: Column) -> Column:
    train, val, test = SPLIT_NAMES
    return F.when(in_train, train).when(in_val, val).otherwise(test)


def _row_key(
    df: DataFrame, plan: SplitPlan, id_columns: list[str] | None
) -> tuple[DataFrame, Column]:
    """A digest per row that depends on the row and the seed only. Time splits draw no lots: they
    use it to break ties, so there the seed stays out."""
    seed = "" if plan.strategy == TIME_BASED else str(plan.seed)
    if id_columns:
        texts = [key_text(df.schema[name]) for name in id_columns]
        return df, F.md5(F.concat(F.concat_ws(SEPARATOR, *texts), F.lit(seed)))
    text = F.concat_ws(SEPARATOR, "tw_h1", "tw_h2", "tw_copy")
    key = F.md5(F.concat(text, F.lit(seed)))
    h1, h2 = struct_hash128("tw_row")
    hashed = (
        df.withColumn("tw_row", row_struct(df.schema.fields, comparable))
        .withColumns({"tw_h1": h1, "tw_h2": h2})
        .drop("tw_row")
    )
    # Only 16 bytes of a row are shuffled to find out which contents are there more than once.
    contents = hashed.groupBy("tw_h1", "tw_h2").agg(F.count(F.lit(1)).alias("tw_n"))
    repeated = stage(contents.filter("tw_n > 1").select("tw_h1", "tw_h2"))
    if repeated.isEmpty():
        return hashed.withColumn("tw_copy", F.lit(1)).withColumn(KEY, key), F.col(KEY)
    if repeated.count() <= BROADCAST_CONTENTS:
        repeated = F.broadcast(repeated)
    single = hashed.join(repeated, ["tw_h1", "tw_h2"], "left_anti").withColumn("tw_copy", F.lit(1).cast("bigint"))
    copies = stage(_number_copies(hashed.join(repeated, ["tw_h1", "tw_h2"], "left_semi")))
    return single.unionByName(copies).withColumn(KEY, key), F.col(KEY)


def _number_copies(hashed: DataFrame) -> DataFrame:
    """Number rows of equal content 1, 2, ... in `tw_copy`, whichever of them gets which number.

    Without it copies would share a key and all land in one partition. Copies are numbered within
    the task that read them and shifted by the counts of the tasks before, so a content that fills
    a third of the table is still spread over as many groups as there are tasks.
    """
    rows = stage(hashed.withColumn("tw_part", F.spark_partition_id()))
    group = ["tw_h1", "tw_h2", "tw_part"]
    earlier = (
        Window.partitionBy("tw_h1", "tw_h2")
        .orderBy("tw_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        rows.groupBy(*group)
        .count()
        .withColumn("tw_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy(*group).orderBy(F.lit(0))
    return (
        rows.withColumn("tw_rank", F.row_number().over(within))
        .join(shifts, group)
        .withColumn("tw_copy", F.col("tw_before") + F.col("tw_rank"))
        .drop("tw_part", "tw_before", "tw_rank")
    )


def _random(df: DataFrame, plan: SplitPlan, key: Column) -> DataFrame:
    train, val = plan.edges(df.count())
    cuts = exact_key_cuts(df, key, {train, val})
    return df.withColumn(
        SPLIT_COLUMN, _named(key <= F.lit(cuts[train]), key <= F.lit(cuts[val]))
    )


def _by_group(df: DataFrame, plan: SplitPlan) -> DataFrame:
    """Whole groups in the order of their digests; a group goes where its last row falls."""
    key = F.md5(F.concat(key_text(df.schema[plan.group_column]), F.lit(str(plan.seed))))
    train, val = plan.edges(df.count())
    cuts = key_cuts(df, key, {train, val}, unique=False)
    return df.withColumn(
        SPLIT_COLUMN, _named(key <= F.lit(cuts[train].last), key <= F.lit(cuts[val].last))
    )


def _by_time(df: DataFrame, plan: SplitPlan, key: Column) -> DataFrame:
    rows = df.count()
    field = df.schema[plan.time_column]
    in_train, in_val = value_cuts(df, field, key, plan.edges(rows), rows)
    return df.withColumn(SPLIT_COLUMN, _named(in_train, in_val))


def _stratified(df: DataFrame, plan: SplitPlan, key: Column) -> DataFrame:
    h1, h2 = hash128([comparable(df.schema[plan.target_column])])
    keyed = df.withColumns({"tw_h1": h1, "tw_h2": h2, KEY: key})
    rows = df.count()
    heavy = (
        keyed.groupBy("tw_h1", "tw_h2")
        .count()
        .filter(F.col("count") * F.lit(HEAVY_STRATA) > F.lit(rows))
        .collect()  # fewer than HEAVY_STRATA rows
    )
    parts = []
    if heavy:
        cuts = F.broadcast(_heavy_cuts(keyed, plan, heavy))
        parts.append(
            keyed.join(cuts, ["tw_h1", "tw_h2"]).withColumn(
                SPLIT_COLUMN,
                _named(F.col(KEY) <= F.col("tw_cut_train"), F.col(KEY) <= F.col("tw_cut_val")),
            )
        )
    if sum(h["count"] for h in heavy) < rows:
        light = keyed
        if heavy:
            known = F.broadcast(_strata_frame(keyed, heavy))
            light = keyed.join(known, ["tw_h1", "tw_h2"], "left_anti")
        parts.append(_light_strata(light, plan))
    columns = [*[col(c) for c in df.columns], SPLIT_COLUMN]
    if not parts:
        return df.withColumn(SPLIT_COLUMN, F.lit(None).cast("string"))
    result = parts[0].select(*columns)
    return result.unionByName(parts[1].select(*columns)) if len(parts) == 2 else result


def _strata_frame(df: DataFrame, heavy: list) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(h["tw_h1"], h["tw_h2"]) for h in heavy], "tw_h1 bigint, tw_h2 bigint"
    )


def _light_strata(light: DataFrame, plan: SplitPlan) -> DataFrame:
    stratum = Window.partitionBy("tw_h1", "tw_h2")
    rank = F.row_number().over(stratum.orderBy(KEY))
    size = F.count(F.lit(1)).over(stratum)
    train, val = (F.col("tw_size") * F.lit(share) for share in plan.shares)
    return (
        light.withColumn("tw_rank", rank.cast("decimal(20,0)"))
        .withColumn("tw_size", size.cast("decimal(20,0)"))
        .withColumn(SPLIT_COLUMN, _named(F.col("tw_rank") <= train, F.col("tw_rank") <= val))
    )


def _heavy_cuts(keyed: DataFrame, plan: SplitPlan, heavy: list) -> DataFrame:
    """Rows (tw_h1, tw_h2, tw_cut_train, tw_cut_val): the last key of each part of each stratum.

    Rows are counted by stratum and key prefix, which finds the bucket where each cut falls; only
    the rows of those buckets are sorted.
    """
    spark = keyed.sparkSession
    edges = spark.createDataFrame(
        [
            (h["tw_h1"], h["tw_h2"], part, edge)
            for h in heavy
            for part, edge in enumerate(plan.edges(h["count"]))
        ],
        "tw_h1 bigint, tw_h2 bigint, part int, edge bigint",
    )
    stratum = ["tw_h1", "tw_h2"]
    # As many prefixes as the size of the stratum asks for.
    digits = spark.createDataFrame(
        [(h["tw_h1"], h["tw_h2"], _prefix_digits(h["count"])) for h in heavy],
        "tw_h1 bigint, tw_h2 bigint, digits int",
    )
    rows = (
        keyed.select(*stratum, F.col(KEY).alias("key"))
        .join(F.broadcast(digits), stratum)
        .withColumn("prefix", F.expr("substring(key, 1, digits)"))
    )
    in_order = Window.partitionBy(*stratum).orderBy("prefix")
    crossed = (
        rows.groupBy(*stratum, "prefix")
        .count()
        .withColumn("upto", F.sum("count").over(in_order))
        .join(F.broadcast(edges), stratum)
        .withColumn("before", F.col("upto") - F.col("count"))
        .filter("before <= edge AND edge < upto")
        .select(*stratum, "part", "prefix", (F.col("edge") - F.col("before")).alias("position"))
        .collect()  # two rows per heavy stratum
    )
    crossings = spark.createDataFrame(
        crossed, "tw_h1 bigint, tw_h2 bigint, part int, prefix string, position bigint"
    )
    bucket = Window.partitionBy(*stratum, "part").orderBy("key")
    hits = (
        rows.join(F.broadcast(crossings), [*stratum, "prefix"])
        .withColumn("row", F.row_number().over(bucket))
        .withColumn("next", F.lead("key").over(bucket))
        .filter("row = position")
        .collect()  # at most two rows per heavy stratum
    )
    if any(h["key"] == h["next"] for h in hits):
        raise SplitError("several rows share one key, the id columns do not identify rows")
    # The bare prefix sorts below every key of its bucket: that is the cut at position 0.
    last = {(c["tw_h1"], c["tw_h2"], c["part"]): c["prefix"] for c in crossed}
    last |= {(h["tw_h1"], h["tw_h2"], h["part"]): h["key"] for h in hits}
    return spark.createDataFrame(
        [
            (h["tw_h1"], h["tw_h2"], *(last[h["tw_h1"], h["tw_h2"], p] for p in (0, 1)))
            for h in heavy
        ],
        "tw_h1 bigint, tw_h2 bigint, tw_cut_train string, tw_cut_val string",
    )


def _prefix_digits(rows: int) -> int:
    """Hex digits that leave some ten thousand rows per bucket, within 16 ** 5 buckets."""
    digits = 1
    while digits < 5 and rows > 10_000 * 16**digits:
        digits += 1
    return digits


def split_counts(assigned: DataFrame) -> DataFrame:
    """Rows (split, rows), one per partition that is not empty."""
    return assigned.groupBy(F.col(SPLIT_COLUMN).alias("split")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def split_summary(assigned: DataFrame) -> DataFrame:
    """Rows (split, rows, share of all rows)."""
    counts = split_counts(assigned)
    total = Window.partitionBy(F.lit(0))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(total))


def part(assigned: DataFrame, name: str) -> DataFrame:
    """One partition, without the helper column."""
    return assigned.filter(F.col(SPLIT_COLUMN) == name).drop(SPLIT_COLUMN)


def write_split(assigned: DataFrame, path: str) -> dict[str, str]:
    """Write one Parquet folder per non-empty partition, in one job; folders by partition name.

    The helper column becomes the folder name and is not in the files.
    """
    assigned.write.partitionBy(SPLIT_COLUMN).parquet(path)
    spark = assigned.sparkSession
    folders = {name: f"{path.rstrip('/')}/{SPLIT_COLUMN}={name}" for name in SPLIT_NAMES}
    return {name: folder for name, folder in folders.items() if path_exists(spark, folder)}


def split_files(
    spark: SparkSession,
    source: str,
    plan: SplitPlan,
    path: str,
    id_columns: list[str] | None = None,
    fmt: str | None = None,
    **reader_options,
) -> dict[str, str]:
    """Split a file or folder into `path`. In Parquet the place of a row, its file and row number,
    identifies it when no id columns do. CSV is parsed once and staged."""
    fmt = fmt or format_of(source)
    if fmt != "parquet":
        table = stage(read(spark, source, fmt, **reader_options))
        return write_split(assign(table, plan, id_columns), path)
    if id_columns:
        return write_split(assign(read(spark, source, fmt), plan, id_columns), path)
    placed = read(spark, source, fmt, row_id=ROW_ID)
    return write_split(assign(placed, plan, [ROW_ID]).drop(ROW_ID), path)
