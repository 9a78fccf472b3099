
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablewright import (  # noqa: E402
    SPLIT_COLUMN,
    Between,
    Catalog,
    Holds,
    Impute,
    Matches,
    NotNull,
    OneHot,
    OneOf,
    Ordinal,
    ProfileOptions,
    References,
    Scale,
    SplitPlan,
    TargetMean,
    Unique,
    assign,
    associations,
    audit,
    boolean_distribution,
    calibration,
    check_rules,
    classification_quality,
    fit_features,
    five_numbers,
    linear_regression,
    logistic_regression,
    missing_bars,
    outliers,
    part,
    profile,
    read,
    schema_report,
    similar_rows,
    spearman,
    split_counts,
    split_summary,
    target_proxies,
)
from tablewright.functions.staging import staging_folder  # noqa: E402
from tablewright.functions.columns import json_scalar  # noqa: E402
from tablewright.operators.charts import temporal_ranges  # noqa: E402
from tablewright.operators.correlation import correlations_with  # noqa: E402
from tablewright.operators.leakage import check_temporal, highest_severity  # noqa: E402
from tablewright.operators.overlap import EXACT, GROUPS, ROUNDED, shared_counts  # noqa: E402
from tablewright.operators.proxies import class_ranges, purities  # noqa: E402
from tablewright.operators.quantiles import quantiles  # noqa: E402
from tablewright.operators.scalars import distinct_counts, scalar_statistics  # noqa: E402
from tablewright.operators.split import split_files, write_split  # noqa: E402
from tablewright.plans.split_plan import SplitError  # noqa: E402
from tablewright.sources.tables import InputError, format_of  # noqa: E402

try:  # a subpackage of its own, which nothing else needs
    import corpus_pipeline
    from tablewright.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

LINEITEM_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def _rounded(name: str, digits: int = 4) -> Column:
    # A rounded negative zero would differ from zero in a hash of the values.
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def _new_folder(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/check-{uuid.uuid4().hex}"


# Profile


def schema_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_report(_table(spark, sf_dir, "orders"))


def column_stats_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(_table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS))
    columns = found.columns(statistics=["distinct"])
    return columns.select(
        "name",
        "row_count",
        "null_count",
        "null_fraction",
        "distinct_count",
        "min",
        "max",
        _rounded("mean"),
        _rounded("stddev"),
    )


def column_stats_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = profile(_table(spark, sf_dir, "events")).columns(statistics=["distinct"])
    return columns.select("position", "name", "dtype", "kind", "null_count", "distinct_count")


def profile_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ProfileOptions(max_histograms=2, max_correlations=8)
    found = profile(_table(spark, sf_dir, "lineitem"), options)
    return spark.createDataFrame(
        [(found.row_count, found.column_count, found.distinct_exact, *found.truncated.values())],
        "row_count bigint, column_count int, distinct_exact boolean, truncated_columns boolean, "
        "truncated_histograms boolean, truncated_top_values boolean, "
        "truncated_correlations boolean",
    )


def distinct_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each HyperLogLog estimate is within a tenth of the exact count."""
    df = _table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(f.name) for f in df.schema])
    exact = distinct_counts(df, df.schema.fields, exact=True)
    estimate = distinct_counts(df, df.schema.fields, exact=False).withColumnRenamed(
        "distinct_count", "estimate"
    )
    close = F.abs(F.col("estimate") / F.col("distinct_count") - 1) < 0.1
    return exact.join(estimate, "position").select(
        names[F.col("position")].alias("name"), "distinct_count", close.alias("close")
    )


def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        five_numbers(profile(_table(spark, sf_dir, name))) for name in ("lineitem", "part")
    ]
    return found[0].unionByName(found[1]).select(
        "name", *[_rounded(c, 6) for c in ("min", "p25", "p50", "p75", "max")]
    )


def quartiles_by_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way quartiles are found in tables of any size: brackets that shrink scan by scan."""
    df = _table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    _, statistics = scalar_statistics(df, df.schema.fields)
    found = quantiles(df, statistics, direct_rows=100)
    return spark.createDataFrame(
        [(name, *values) for name, values in found.items()],
        "name string, p25 double, p50 double, p75 double",
    ).select("name", *[_rounded(c, 6) for c in ("p25", "p50", "p75")])


def temporal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [temporal_ranges(profile(_table(spark, sf_dir, name))) for name in ("orders", "events")]
    return found[0].unionByName(found[1])


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    good = F.when(F.col("toxic") == 0, F.col("quality") == 1)
    return labels.select(good.alias("good"), (F.col("toxic") == 1).alias("toxic"))


def boolean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean_distribution(profile(_flags(spark, sf_dir)))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        profile(_table(spark, sf_dir, name)).histograms() for name in ("lineitem", "customer")
    ]
    return found[0].unionByName(found[1]).select(
        "column", "bin", _rounded("bin_start", 6), _rounded("bin_end", 6), "count"
    )


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [profile(_table(spark, sf_dir, name)).top_values() for name in ("orders", "events")]
    return found[0].unionByName(found[1])


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("l_linenumber") != 7
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(known, F.col("l_quantity")).alias("l_quantity"),
        F.when(known & (F.col("l_tax") > 0), F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"),
    )


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = missing_bars(profile(_with_gaps(spark, sf_dir)))
    return bars.select("name", "null_count", _rounded("percent", 6))


def correlation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(_table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)).correlations()
    return found.select("row_name", "column_name", _rounded("r", 8))


def correlation_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(_with_gaps(spark, sf_dir)).correlations()
    return found.select("row_name", "column_name", _rounded("r", 8))


def correlation_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    features = [f for f in df.schema if f.name in LINEITEM_NUMBERS and f.name != "l_quantity"]
    return correlations_with(df, features, "l_quantity").select("column", _rounded("r", 8))


def spearman_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of lineitem, which is full of ties."""
    found = spearman(_table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS))
    return found.select("row_name", "column_name", _rounded("r", 8))


def spearman_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with gaps of their own: each pair is ranked within the rows that it has in common."""
    found = spearman(_with_gaps(spark, sf_dir).drop("l_returnflag"))
    return found.select("row_name", "column_name", _rounded("r", 8))


def associations_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, whole numbers and fractions of orders, some with gaps."""
    df = _table(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.year("o_orderdate").alias("year"),
        "o_totalprice",
        (F.col("o_custkey") % 10 == 3).alias("third"),
        "o_custkey",
    )
    found = associations(df)
    return found.select("row_name", "column_name", "rows", _rounded("cramers_v", 8), _rounded("mutual_information", 8))


def outlier_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences and median deviations of lineitem, with prices that are far off now and then."""
    far = F.when(F.col("l_orderkey") % 53 == 0, F.col("l_extendedprice") * 9).otherwise(F.col("l_extendedprice"))
    df = _table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        far.alias("price"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * F.col("l_tax")).alias("tax"),
        (F.col("l_discount") * 100).cast("int").alias("discount"),
    )
    numbers = [_rounded(c, 6) for c in ("p25", "p50", "p75", "low_fence", "high_fence", "mad")]
    return outliers(df).select("name", "filled", *numbers, "below", "above", "far")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on rows, keys and references of lineitem, some of which its rows break."""
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    rules = [
        NotNull("l_shipdate"),
        Between("l_discount", 0.02, 0.08),
        Between("l_quantity", 1),
        OneOf("l_returnflag", ("A", "N")),
        Matches("l_linestatus", "^[O]$"),
        Holds("l_extendedprice >= 1000 * l_tax * l_quantity"),
        Unique(("l_orderkey", "l_linenumber")),
        Unique(("l_orderkey", "l_partkey", "l_suppkey")),
        References(("l_orderkey",), "orders", ("o_orderkey",)),
        References(("l_suppkey",), "supplier", ("s_suppkey",)),
    ]
    tables = {"orders": orders, "supplier": _table(spark, sf_dir, "supplier")}
    return check_rules(_table(spark, sf_dir, "lineitem"), rules, tables).select("position", "rows", "failing", "passed")


def baseline_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of lineitem by quantity and tax, where both are known."""
    model = linear_regression(_with_prices(spark, sf_dir), "l_extendedprice", ["l_quantity", "l_tax"])
    return model.table(spark).select("position", "feature", _rounded("coefficient", 3))


def _with_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.when(F.col("l_linenumber") != 7, F.col("l_tax"))
    return _table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", tax.alias("l_tax"))


def _returned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whether a line was returned, and what a model of odd orders says of even ones."""
    df = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linenumber") <= 3).cast("int").alias("early"),
        (F.col("l_quantity") > 20).cast("int").alias("large"),
        "l_orderkey",
    )
    df = df.withColumn("both", F.col("early") * F.col("large"))
    model = logistic_regression(df.filter("l_orderkey % 2 = 1"), "returned", ["early", "large", "both"])
    return model.table(spark), model.predict(df.filter("l_orderkey % 2 = 0"))


def baseline_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returned(spark, sf_dir)[0].select("position", "feature", _rounded("coefficient", 6))


def baseline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classification_quality(_returned(spark, sf_dir)[1], "prediction", "returned")
    return found.select("rows", "positives", *[_rounded(c, 8) for c in ("auc", "brier", "log_loss")])


def baseline_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often lines are returned, by a score made of their discount and tax."""
    df = _table(spark, sf_dir, "lineitem").select(
        ((F.col("l_discount") * 700 + F.col("l_tax") * 300) / 97).alias("score"), (F.col("l_returnflag") == "R").alias("returned")
    )
    return calibration(df, "score", "returned", 7).select("bin", "rows", _rounded("mean_score", 6), _rounded("positive_rate", 6))


# Split

RANDOM_PLAN = SplitPlan("random", 0.7, 0.2, 0.1)
STRATIFIED_PLAN = SplitPlan("stratified", 0.7, 0.15, 0.15, target_column="o_orderstatus")
MANY_STRATA_PLAN = SplitPlan("stratified", 0.6, 0.2, 0.2, target_column="o_custkey")
TIME_PLAN = SplitPlan("time_based", 0.6, 0.2, 0.2, time_column="ts")
TIED_TIME_PLAN = SplitPlan("time_based", 0.7, 0.15, 0.15, time_column="o_orderdate")
GROUP_PLAN = SplitPlan("group", 0.7, 0.15, 0.15, group_column="user_id")


def _assigned(table: str, plan: SplitPlan, key: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        assigned = assign(_table(spark, sf_dir, table), plan, [key])
        return assigned.select(key, F.col(SPLIT_COLUMN).alias("split"))

    return query


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = split_summary(assign(_table(spark, sf_dir, "orders"), RANDOM_PLAN, ["o_orderkey"]))
    return summary.select("split", "rows", _rounded("share", 6))


def split_sizes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows told apart by their place in the file, written, and counted in the files."""
    folder = _new_folder(spark)
    split_files(spark, f"{sf_dir}/lineitem.parquet", SplitPlan(), folder)
    return _sizes_and_sums(spark.read.parquet(folder), LINEITEM_NUMBERS)


def split_sizes_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is nearly all copies, without a column that identifies a row."""
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    df = df.withColumn("l_discount", F.round(F.col("l_discount") * 100).cast("int"))
    return _sizes_and_sums(assign(df, SplitPlan()), ["l_discount"])


def _sizes_and_sums(assigned: DataFrame, numbers: list[str]) -> DataFrame:
    """Rows per part, and over all parts a digest of sums that each row has a share in: what is
    lost, doubled or changed by a split shows in it."""
    total = Window.partitionBy(F.lit(0))
    cents = [F.sum(F.round(F.col(n) * 100).cast("bigint")) for n in numbers]
    sums = assigned.groupBy(F.col(SPLIT_COLUMN).alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), *[c.alias(f"sum{i}") for i, c in enumerate(cents)]
    )
    return sums.select(
        "split", "rows", *[F.sum(f"sum{i}").over(total).alias(f"all_{n}") for i, n in enumerate(numbers)]
    )


def split_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark)
    assigned = assign(_table(spark, sf_dir, "orders"), STRATIFIED_PLAN, ["o_orderkey"])
    folders = write_split(assigned, folder)
    read_back = [
        spark.read.parquet(path).select(F.lit(name).alias("split"), "o_orderkey", "o_orderstatus")
        for name, path in folders.items()
    ]
    rows = read_back[0].unionByName(read_back[1]).unionByName(read_back[2])
    return rows.groupBy("split", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("sum_keys")
    )


# Audit


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("target"),
        (F.col("l_quantity") * 3 + 1).alias("copy"),
        (F.col("l_quantity") + F.col("l_tax")).alias("noisy"),
        "l_extendedprice",
        "l_discount",
        "l_partkey",
        "l_returnflag",
    )


def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("target"),
        "l_quantity",
        "l_extendedprice",
        "l_tax",
        F.when(F.col("l_quantity") > 25, "many").otherwise("few").alias("size"),
        "l_returnflag",
    )


def _dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    mostly = F.when((status == "O") & (F.col("o_totalprice") < 1500), "x").otherwise(status)
    return _table(spark, sf_dir, "orders").select(
        status.alias("target"),
        F.concat(F.lit("s"), status).alias("code"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lower(status)).alias("gaps"),
        F.concat(mostly, F.col("o_orderpriority")).alias("mixed"),
        "o_orderpriority",
        "o_orderkey",
        "o_custkey",
    )


def _proxies(frame: Callable[[SparkSession, str], DataFrame]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return target_proxies(frame(spark, sf_dir), "target").select("column", "signal", "value")

    return query


def ranges_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    features = [f for f in df.schema if f.name in LINEITEM_NUMBERS]
    return class_ranges(df, features, "l_returnflag")


def value_purities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    features = [f for f in df.schema if f.name != "l_returnflag"]
    return purities(df, features, "l_returnflag").select("column", "values", _rounded("purity", 6))


def _halves(
    spark: SparkSession, sf_dir: str, table: str, plan: SplitPlan, key: str
) -> tuple[DataFrame, DataFrame]:
    assigned = assign(_table(spark, sf_dir, table), plan, [key])
    return part(assigned, "train"), part(assigned, "test")


def row_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: copies of a document land on both sides of a random split."""
    train, test = (
        half.select("text", "lang")
        for half in _halves(spark, sf_dir, "documents", RANDOM_PLAN, "doc_id")
    )
    counts = shared_counts(train, test, 3)
    return spark.createDataFrame([(counts[EXACT],)], "shared_rows bigint")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements that differ in the seventh decimal."""
    train, test = (
        half.select(
            "event_type", (F.col("value") + F.col("user_id") / F.lit(1e9)).alias("value")
        )
        for half in _halves(spark, sf_dir, "events", RANDOM_PLAN, "event_id")
    )
    counts = shared_counts(train, test, 3)
    return spark.createDataFrame(
        [(counts[EXACT], max(0, counts[ROUNDED] - counts[EXACT]))],
        "exact_duplicates bigint, near_duplicates bigint",
    )


def similar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the test part that nearly equal one of train in price and day; one of status and
    priority may differ."""
    train, test = (
        half.withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")))
        for half in _halves(spark, sf_dir, "orders", RANDOM_PLAN, "o_orderkey")
    )
    scales, categories = {"o_totalprice": 2000.0, "day": 20.0}, ["o_orderstatus", "o_orderpriority"]
    found = similar_rows(test, train, scales, categories, differing=1)
    strict = similar_rows(found.withColumnRenamed("similar", "loose"), train, scales, categories)
    return strict.select("o_orderkey", "loose", F.col("similar").alias("strict"))


def temporal_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for plan in (TIME_PLAN, RANDOM_PLAN):
        train, test = _halves(spark, sf_dir, "events", plan, "event_id")
        found = check_temporal(train, test, "ts", plan.strategy)
        rows.append((plan.strategy, found["severity"], *found["details"].values()))
    return spark.createDataFrame(
        rows, "strategy string, severity string, max_train string, min_test string"
    )


def group_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for plan in (GROUP_PLAN, RANDOM_PLAN):
        train, test = _halves(spark, sf_dir, "events", plan, "event_id")
        rows.append((plan.strategy, shared_counts(train, test, 3, "user_id")[GROUPS]))
    return spark.createDataFrame(rows, "strategy string, shared_groups bigint")


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks on a random split of events, with a name that gives itself away."""
    train, test = (
        half.select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            F.col("value").alias("value_final"),
            "props",
            F.upper("event_type").alias("label"),
        )
        for half in _halves(spark, sf_dir, "events", RANDOM_PLAN, "event_id")
    )
    report = audit(train, test, "event_type", time_column="ts", group_column="user_id")
    return report.select("position", "check", "severity", F.concat_ws(",", "columns").alias("columns"))


# Sources and catalog


def csv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read back with inferred types."""
    folder = _new_folder(spark) + "/orders.csv"
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    orders.write.option("header", True).csv(folder)
    columns = profile(read(spark, folder), staged=True).columns(statistics=["distinct"])
    return columns.select(
        "position", "name", "dtype", "kind", "row_count", "null_count", "distinct_count", _rounded("mean")
    )


def catalog_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register a file, split it, list its children and the recorded sizes."""
    folder = _new_folder(spark)
    catalog = Catalog(spark, f"{folder}/catalog")
    dataset = catalog.register(f"{sf_dir}/events.parquet", "events")
    split_id = catalog.split(dataset, GROUP_PLAN, f"{folder}/split", ["event_id"])
    recorded = catalog.table("split_configs").filter(F.col("id") == split_id)
    sizes = recorded.select(F.explode("row_counts").alias("split", "recorded"))
    children = catalog.children(dataset).select(
        "name", F.col("row_count_estimate").alias("rows"), "format"
    )
    return children.withColumn("split", F.substring_index("name", " ", -1)).join(sizes, "split")


def csv_semicolon_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV with semicolons: registered, profiled and split through the catalog."""
    folder = _new_folder(spark)
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    orders.write.options(header=True, sep=";").csv(f"{folder}/orders.csv")
    catalog = Catalog(spark, f"{folder}/catalog")
    dataset = catalog.register(f"{folder}/orders.csv", "orders", sep=";")
    catalog.profile(dataset)
    found = catalog.latest_profile(dataset)
    split_id = catalog.split(dataset, RANDOM_PLAN, f"{folder}/split", ["o_orderkey"])
    keys = [
        catalog.frame(row["id"]).agg(F.sum("o_orderkey").alias("keys")).withColumn("name", F.lit(row["name"]))
        for row in catalog.children(dataset).collect()
    ]
    recorded = catalog.split_config(split_id)["row_counts"]
    sums = keys[0].union(keys[1]).union(keys[2])
    counts = F.create_map(*[F.lit(x) for pair in recorded.items() for x in pair])
    split = F.substring_index("name", " ", -1)
    return sums.select(
        split.alias("split"),
        counts[split].alias("rows"),
        F.col("keys").alias("sum_keys"),
        F.lit(found["column_count"]).alias("columns"),
        F.lit(found["row_count"]).alias("profiled_rows"),
    )


def catalog_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets, three profiles, two splits and their audits, as the catalog lists them."""
    folder = _new_folder(spark)
    catalog = Catalog(spark, f"{folder}/catalog")
    events = catalog.register(f"{sf_dir}/events.parquet", "events")
    orders = catalog.register(f"{sf_dir}/orders.parquet", "orders")
    small = ProfileOptions(max_columns=1, max_histograms=0, max_categorical=0)
    profiles = [catalog.profile(d, small) for d in (events, orders, events)]
    plans = (SplitPlan("random", 0.6, 0.2, 0.2, group_column="user_id"), GROUP_PLAN)
    splits = [catalog.split(events, p, f"{folder}/{i}", ["event_id"]) for i, p in enumerate(plans)]
    reports = [catalog.audit(s, "event_type") for s in splits]
    datasets = catalog.datasets().collect()
    rows = [("dataset", f"{i} {d['name']}", d["row_count_estimate"]) for i, d in enumerate(datasets) if not d["parent_dataset_id"]]
    rows += [("profile", "profiles of events", catalog.profiles(events).count())]
    rows += [("profile", "latest is the last", int(catalog.latest_profile(events)["id"] == profiles[2]))]
    rows += [("profile", "rows of orders", catalog.latest_profile(orders)["row_count"])]
    rows += [("split", s["strategy"], s["row_counts"]["train"]) for s in catalog.splits(events).collect() if s["strategy"] == "random"]
    rows += [("split", "newest first", int([s["id"] for s in catalog.splits(events).collect()] == splits[::-1]))]
    for split_id, report_id in zip(splits, reports):
        latest, config = catalog.latest_report(split_id), catalog.split_config(split_id)
        rows.append(("report", f"{config['strategy']} {latest['highest_severity']}", int(latest["id"] == report_id)))
    child = catalog.split_config(splits[0])["test_dataset_id"]
    rows += [("lineage", r["name"], r["depth"]) for r in catalog.lineage(child).collect()]
    return spark.createDataFrame(rows, "part string, name string, value bigint")


def formats_and_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under several names: read by extension, or refused with a reason."""
    folder = _new_folder(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    orders.write.parquet(f"{folder}/a.PQ")
    orders.write.parquet(f"{folder}/b.xlsx")
    orders.write.option("header", True).csv(f"{folder}/c.Csv")
    orders.write.option("header", True).csv(f"{folder}/d.parquet")
    rows = []
    for name in ("a.PQ", "b.xlsx", "c.Csv", "d.parquet", "missing.csv"):
        try:
            read_rows = read(spark, f"{folder}/{name}").count()
        except InputError:
            read_rows = None
        rows.append((name, format_of(name), read_rows))
    return spark.createDataFrame(rows, "name string, format string, rows bigint")


def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as JSON can carry them: no NaN or infinity, dates and times as ISO text."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderkey") % 3 == 0, float("nan"))
        .when(F.col("o_orderkey") % 3 == 1, float("-inf"))
        .otherwise(F.col("o_totalprice"))
        .alias("price"),
        F.encode("o_orderpriority", "utf-8").alias("raw"),
    )
    return orders.select(*[json_scalar(F.col(f.name), f.dataType).alias(f.name) for f in orders.schema])


def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of a profile of events, taken apart."""
    summary = profile(_table(spark, sf_dir, "events")).summary()
    rows = [
        (
            c["name"],
            c["kind"],
            summary["row_count"],
            c["null_count"],
            c["distinct_count"],
            sum(b["count"] for b in c["histogram"]) if "histogram" in c else None,
            c["top_values"][0]["count"] if "top_values" in c else None,
        )
        for c in summary["columns"]
    ]
    return spark.createDataFrame(
        rows,
        "name string, kind string, row_count bigint, null_count bigint, distinct_count bigint, "
        "in_histogram bigint, top_count bigint",
    )


def profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """250 derived columns, none of them left out."""
    line = _table(spark, sf_dir, "lineitem")
    wide = line.select(*[(F.col("l_quantity") * (i % 50 + 1) + F.col("l_linenumber") * i).alias(f"v{i:03d}") for i in range(250)])
    columns = profile(wide).columns(statistics=())
    return columns.select("name", "row_count", "null_count", "min", "max", _rounded("mean", 6))


def distinct_exact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of over a million rows are counted, not estimated."""
    line = _table(spark, sf_dir, "lineitem").select(
        F.explode(F.sequence(F.lit(0), F.lit(19))).alias("copy"), "l_orderkey", "l_partkey", "l_extendedprice"
    )
    large = line.select(
        (F.col("l_orderkey") * 20 + F.col("copy")).alias("order_copy"),
        (F.col("l_partkey") + F.col("copy")).alias("shifted"),
        (F.col("l_extendedprice") * (F.col("copy") % 3)).alias("price"),
    )
    return profile(large).columns(statistics=["distinct"]).select("name", "distinct_count", "distinct_exact")


def correlation_clustered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where y is known x lies in a small cluster far from its mean."""
    far = F.col("l_linenumber") > 4
    df = _table(spark, sf_dir, "lineitem").select(
        F.when(far, F.col("l_quantity") + 1e7).otherwise(F.col("l_tax")).alias("x"),
        F.when(far, F.col("l_quantity") * 3 - 2).alias("y"),
        F.when(far, F.col("l_quantity") + F.col("l_discount") * 100).alias("z"),
    )
    return profile(df).correlations().select("row_name", "column_name", _rounded("r", 6))


def _timed(column: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "events").select("event_id", column().alias("at"))
        plan = SplitPlan("time_based", 0.6, 0.2, 0.2, time_column="at")
        return assign(df, plan, ["event_id"]).select("event_id", F.col(SPLIT_COLUMN).alias("split"))

    return query


def _times() -> dict[str, Callable[[], Column]]:
    """Columns of events that order rows in another way than time stamps do."""
    mixed = "event_id * 7919 % 4001"
    largest = (1 << 63) - 1
    return {
        "decimal": lambda: F.expr(f"cast(concat({mixed} - 2000, 'e-18') as decimal(38,18))"),
        "text": lambda: F.concat(F.lit("a"), F.repeat(F.lit("\0"), F.expr(f"cast({mixed} % 40 as int)"))),
        "bigint": lambda: F.expr(f"if({mixed} % 2 = 0, {largest} - {mixed}, {mixed} - {largest})"),
        "interval": lambda: F.expr(f"make_dt_interval(0, 0, 0, {mixed} - 2000.25)"),
    }


def split_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seed twice and another one: how many orders are in the same part."""
    orders = _table(spark, sf_dir, "orders")
    parts = [
        assign(orders, SplitPlan(seed=seed), ["o_orderkey"]).select("o_orderkey", F.col(SPLIT_COLUMN).alias(f"s{i}"))
        for i, seed in enumerate((7, 7, 8))
    ]
    joined = parts[0].join(parts[1], "o_orderkey").join(parts[2], "o_orderkey")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("s0") == F.col("s1")).alias("same_seed"),
        F.count_if(F.col("s0") == F.col("s2")).alias("other_seed"),
    )


def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the files of a split: those of the table and no others."""
    folder = _new_folder(spark)
    folders = write_split(assign(_table(spark, sf_dir, "orders"), RANDOM_PLAN, ["o_orderkey"]), folder)
    rows = [(name, c) for name, path in folders.items() for c in spark.read.parquet(path).columns]
    return spark.createDataFrame(rows, "split string, column string")


def split_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that orders can't be split by, and the number of their faults; rows of the one that works."""
    orders = _table(spark, sf_dir, "orders")
    plans = {
        "shares": SplitPlan(train=0.5, val=0.2, test=0.2),
        "empty train": SplitPlan(train=0.0, val=0.2, test=0.8),
        "no column": SplitPlan("group"),
        "unknown column": SplitPlan("time_based", time_column="shipped"),
        "everything": SplitPlan("other", train=0.0, val=-0.5, test=1.0, target_column="nope"),
        "fine": RANDOM_PLAN,
    }
    rows = []
    for name, plan in plans.items():
        try:
            rows.append((name, 0, assign(orders, plan, ["o_orderkey"]).count()))
        except SplitError:
            rows.append((name, len(plan.problems(orders.columns)), None))
    return spark.createDataFrame(rows, "plan string, faults int, rows bigint")


def audit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """130 columns, of which the last is the target and another one ends in a telling name."""
    orders = _table(spark, sf_dir, "orders")
    hashes = [F.pmod(F.col("o_orderkey") * (2 * i + 3), F.lit(97)).alias(f"c{i:03d}") for i in range(128)]
    wide = orders.select(F.col("o_totalprice").alias("target"), *hashes, (F.col("o_custkey") % 89).alias("score_final"), F.col("o_totalprice").alias("again"))
    report = audit(wide.filter("c000 < 60"), wide.filter("c000 >= 60"), "target")
    return report.filter("check IN ('target_proxy', 'post_outcome_names')").select(
        "check", "severity", F.concat_ws(",", "columns").alias("columns")
    )


def row_overlap_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test has a third of the rows of train, with wider types and other column order."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"),
        F.col("o_custkey").cast("int").alias("o_custkey"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderstatus",
    )
    test = orders.filter("o_orderkey % 3 = 0").select(
        "o_orderstatus",
        F.col("day").cast("timestamp_ntz").alias("day"),
        F.col("o_custkey").cast("decimal(20,0)").alias("o_custkey"),
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
    )
    counts = shared_counts(orders, test, 3, "o_custkey")
    return spark.createDataFrame([(counts[EXACT], counts[GROUPS])], "shared_rows bigint, shared_groups bigint")


def audit_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of the audits of three splits of events."""
    rows = []
    for plan in (TIME_PLAN, RANDOM_PLAN, GROUP_PLAN):
        train, test = (
            half.select("ts", "user_id", "value", "event_type")
            for half in _halves(spark, sf_dir, "events", plan, "event_id")
        )
        report = audit(
            train, test, "value", strategy=plan.strategy, time_column=plan.time_column, group_column=plan.group_column
        )
        rows.append((plan.strategy, highest_severity(report)))
    return spark.createDataFrame(rows, "strategy string, severity string")


def _events_with_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events split by time, with values and types missing here and there."""
    df = _table(spark, sf_dir, "events").withColumns(
        {
            "value": F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")),
            "age": F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 97),
            "kind": F.when(F.col("event_id") % 6 != 0, F.col("event_type")),
        }
    )
    assigned = assign(df, TIME_PLAN, ["event_id"])
    return part(assigned, "train"), part(assigned, "test")


def features_imputed_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of test filled and its numbers scaled with what train says."""
    train, test = _events_with_gaps(spark, sf_dir)
    copies = {"value2": F.col("value"), "age2": F.col("age"), "age3": F.col("age")}
    steps = [
        Impute(("value", "age"), "mean"),
        Impute(("value2", "age2"), "median"),
        Impute(("kind",), "mode"),
        Scale(("value", "age"), "standard"),
        Scale(("age2",), "robust"),
        Scale(("age3",), "min_max"),
    ]
    fitted = fit_features(train.withColumns(copies), steps)
    numbers = [_rounded(c, 6) for c in ("value", "age", "value2", "age2", "age3")]
    return fitted.transform(test.withColumns(copies)).select("event_id", "kind", *numbers)


def features_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of both parts as places, as columns of 0 and 1, and as mean values out of fold."""
    train, test = _events_with_gaps(spark, sf_dir)
    copies = {"place": F.col("kind"), "user": F.col("user_id"), "mean_kind": F.col("kind"), "mean_user": F.col("user_id")}
    train, test = (p.filter("NOT isnan(value) OR value IS NULL").withColumns(copies) for p in (train, test.filter("event_id % 2 = 0")))
    steps = [
        Ordinal(("place", "user")),
        OneHot(("kind",), limit=3),
        TargetMean(("mean_kind", "mean_user"), "value", ("event_id",)),
    ]
    fitted = fit_features(train, steps)
    both = fitted.transform(train, training=True).withColumn("part", F.lit("train")).unionByName(
        fitted.transform(test).withColumn("part", F.lit("test"))
    )
    hot = sorted(c for c in both.columns if c.startswith("kind="))
    hot_text = F.concat_ws(",", *[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in hot])
    return both.select("part", "event_id", "place", "user", hot_text.alias("hot"), _rounded("mean_kind", 6), _rounded("mean_user", 6))


def pipeline_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature steps fitted on train, on test and on all events, and what the audit says of each."""
    folder = _new_folder(spark)
    catalog = Catalog(spark, f"{folder}/catalog")
    events = catalog.register(f"{sf_dir}/events.parquet", "events")
    split_id = catalog.split(events, GROUP_PLAN, f"{folder}/split", ["event_id"])
    config = catalog.split_config(split_id)
    steps = [Impute(("value",), "median"), Scale(("value",)), Ordinal(("event_type",))]
    rows = []

    def judged(state: str) -> None:
        checks = catalog.report(catalog.audit(split_id, "value"))["checks"]
        [check] = [c for c in checks if c["check"] == "pipeline_contamination"]
        versions = catalog.feature_pipelines(split_id).count()
        rows.append((state, versions, check["severity"], ",".join(check["columns"]), len(check["details"])))

    judged("none")
    for state, dataset in (("train", config["train_dataset_id"]), ("all", events), ("test", config["test_dataset_id"])):
        pipeline = catalog.fit_features(dataset, steps, f"{folder}/features", split_id=split_id)
        judged(state)
    fine = catalog.features(catalog.fit_features(config["train_dataset_id"], steps, f"{folder}/features"))
    judged("train again")
    out = fine.transform(catalog.frame(config["test_dataset_id"])).filter("value IS NOT NULL").count()
    rows.append(("rows of test", out, catalog.feature_pipeline(pipeline)["name"], "", 0))
    return spark.createDataFrame(rows, "state string, versions bigint, severity string, columns string, steps int")


def entry(spark: SparkSession) -> DataFrame:
    """Per-column statistics of lineitem."""
    return profile(_table(spark, "/root/testdata/sf0.001", "lineitem")).columns()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "schema_nulls": schema_nulls,
        "column_stats_numeric": column_stats_numeric,
        "column_stats_of_every_kind": column_stats_of_every_kind,
        "profile_overview": profile_overview,
        "distinct_estimates": distinct_estimates,
        "quartiles": quartiles,
        "quartiles_by_narrowing": quartiles_by_narrowing,
        "temporal_range": temporal_range,
        "boolean_counts": boolean_counts,
        "histograms": histograms,
        "top_values": top_values,
        "missing_values": missing_values,
        "correlation_long": correlation_long,
        "correlation_with_gaps": correlation_with_gaps,
        "correlation_with_target": correlation_with_target,
        "spearman_long": spearman_long,
        "spearman_with_gaps": spearman_with_gaps,
        "associations_mixed": associations_mixed,
        "outlier_fences": outlier_fences,
        "quality_rules": quality_rules,
        "baseline_linear": baseline_linear,
        "baseline_logistic": baseline_logistic,
        "baseline_quality": baseline_quality,
        "baseline_calibration": baseline_calibration,
        "split_random": _assigned("orders", RANDOM_PLAN, "o_orderkey"),
        "split_stratified": _assigned("orders", STRATIFIED_PLAN, "o_orderkey"),
        "split_many_strata": _assigned("orders", MANY_STRATA_PLAN, "o_orderkey"),
        "split_time": _assigned("events", TIME_PLAN, "event_id"),
        "split_time_with_ties": _assigned("orders", TIED_TIME_PLAN, "o_orderkey"),
        "split_group": _assigned("events", GROUP_PLAN, "event_id"),
        "split_sizes": split_sizes,
        "split_sizes_of_files": split_sizes_of_files,
        "split_sizes_of_copies": split_sizes_of_copies,
        "split_written": split_written,
        "proxy_correlation": _proxies(_linear),
        "proxy_separation": _proxies(_threshold),
        "proxy_dependency": _proxies(_dependent),
        "ranges_by_class": ranges_by_class,
        "value_purities": value_purities,
        "row_overlap": row_overlap,
        "near_duplicates": near_duplicates,
        "similar_orders": similar_orders,
        "temporal_leak": temporal_leak,
        "group_leak": group_leak,
        "audit_report": audit_report,
        "csv_stats": csv_stats,
        "csv_semicolon_cycle": csv_semicolon_cycle,
        "catalog_walk": catalog_walk,
        "formats_and_refusals": formats_and_refusals,
        "json_scalars": json_scalars,
        "summary_document": summary_document,
        "profile_wide": profile_wide,
        "distinct_exact_large": distinct_exact_large,
        "correlation_clustered_gaps": correlation_clustered_gaps,
        **{f"split_time_by_{name}": _timed(column) for name, column in _times().items()},
        "split_seeds": split_seeds,
        "split_columns": split_columns,
        "split_refusals": split_refusals,
        "audit_wide": audit_wide,
        "row_overlap_widened": row_overlap_widened,
        "audit_severities": audit_severities,
        "catalog_children": catalog_children,
        "features_imputed_scaled": features_imputed_scaled,
        "features_encoded": features_encoded,
        "pipeline_contamination": pipeline_contamination,
        **(llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES

    if not llm:
        return ORACLES
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | llm.ORACLES | pipeline
