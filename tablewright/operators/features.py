"""Feature steps: learned from one frame, the training part, and applied to any.

A step is a plain description. Fitting gives it a state: a few numbers per column, or, for
categories, a table with one row per category that stays in Spark. Numbers become constants of the
plan, so imputing and scaling join nothing and shuffle nothing; categories are joined, those that
hold much of the rows by a broadcast table of at most HOT rows per column.

Each state names the dataset that it was fitted on, which is what an audit asks for.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, finite_double
from tablewright.functions.staging import stage
from tablewright.operators.quantiles import QUARTILES, quantiles
from tablewright.operators.scalars import scalar_statistics

#: Categories of a column that hold more than a HOT-th of its rows are broadcast.
HOT = 1000
#: Tasks that share the rows of the categories that are not joined by value, and rank one column.
SALTS = 64

IMPUTE = ("mean", "median", "mode", "constant")
SCALE = ("standard", "min_max", "robust")


class FeatureError(ValueError):
    """A step that can't be fitted to this frame."""


@dataclass(frozen=True)
class Impute:
    """Nulls and NaN become the mean, median, most frequent value or a constant.

    Mean and median make the column double. Of equally frequent values the one of the least text
    counts. A column without any value keeps its nulls."""

    columns: tuple[str, ...]
    strategy: str = "mean"
    value: str | float | None = None


@dataclass(frozen=True)
class Scale:
    """`standard`: from the mean in sample deviations; `min_max`: 0 to 1; `robust`: from the median in
    quartile distances. Values of a constant column become 0; test values are not clipped."""

    columns: tuple[str, ...]
    method: str = "standard"


@dataclass(frozen=True)
class Ordinal:
    """Categories become their place in the order of their texts, from 0; unseen ones -1, null stays."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class OneHot:
    """A column `name=category` of 0 and 1 for each of the `limit` most frequent categories (of equally
    frequent ones those of the least text), and `name=*` for all others; null is 0 everywhere."""

    columns: tuple[str, ...]
    limit: int = 50


@dataclass(frozen=True)
class TargetMean:
    """Categories become the mean of the target, drawn to the overall mean by `smoothing` rows' weight.

    Rows of the training frame get the mean over the other folds, so none sees its own target; the
    fold follows from the values of `id_columns`. Null is a category; unseen ones get the overall
    mean. Rows without a target teach nothing."""

    columns: tuple[str, ...]
    target: str
    id_columns: tuple[str, ...]
    folds: int = 5
    smoothing: float = 10.0
    seed: int = 42


Step = Impute | Scale | Ordinal | OneHot | TargetMean
KINDS = {c.__name__: c for c in (Impute, Scale, Ordinal, OneHot, TargetMean)}


@dataclass(frozen=True)
class FittedStep:
    """A step, what it learned, and on which dataset."""

    step: Step
    state: dict
    fitted_on: str | None = None
    table: DataFrame | None = field(default=None, compare=False)

    def described(self) -> dict:
        """What a catalog can keep as JSON; the table is kept beside."""
        return {
            "kind": type(self.step).__name__,
            "step": asdict(self.step),
            "state": self.state,
            "fitted_on": self.fitted_on,
        }


def _fields(df: DataFrame, names: tuple[str, ...]) -> list[T.StructField]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise FeatureError(f"columns that are not there: {', '.join(missing)}")
    return [df.schema[n] for n in names]


def _numbers(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[dict]]:
    """The finite values of numeric columns and their statistics, from one scan."""
    fields = _fields(df, names)
    wrong = [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]
    if wrong:
        raise FeatureError(f"columns that are no numbers: {', '.join(wrong)}")
    finite = df.select(*[finite_double(f).alias(f.name) for f in fields])
    return finite, scalar_statistics(finite, finite.schema.fields)[1]


def category_counts(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """column (its place in `names`), category (as text, null too) and rows, for all columns in one job."""
    _fields(df, names)
    cells = F.array(*[col(n).cast("string") for n in names])
    each = df.select(F.posexplode(cells).alias("column", "category"))
    return each.groupBy("column", "category").agg(F.count(F.lit(1)).alias("rows"))


def most_frequent(counts: DataFrame, limit: int) -> dict[int, list[str]]:
    """By column the `limit` most frequent categories, ranked in SALTS tasks first."""
    order = [F.desc("rows"), F.asc("category")]
    known = counts.filter("category IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("category"), F.lit(SALTS)))
    first = known.withColumn("rank", F.row_number().over(Window.partitionBy("column", "salt").orderBy(*order)))
    best = first.filter(F.col("rank") <= limit)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    found: dict[int, list[str]] = {}
    for r in best.filter(F.col("rank") <= limit).orderBy("column", "rank").collect():
        found.setdefault(r["column"], []).append(r["category"])
    return found


def numbered(counts: DataFrame) -> DataFrame:
    """column, category, code: places in the order of the categories of a column, without one task
    that sees them all. Sorted in ranges, each category gets its place in its range; the ranges' sizes
    are added up on the driver."""
    by = ["column", "category"]
    ranged = counts.filter("category IS NOT NULL").select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(ranged.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).cast("int")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part"), "column").agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("first"))
    offsets, upto = [], {}
    for r in sorted(sizes.collect(), key=lambda r: (r["column"], r["part"])):  # one per range and column
        offsets.append((r["part"], r["column"], upto.get(r["column"], 0) - r["first"]))
        upto[r["column"]] = upto.get(r["column"], 0) + r["n"]
    ranges = counts.sparkSession.createDataFrame(offsets, "part int, column int, offset bigint")
    joined = placed.withColumn("part", part).join(F.broadcast(ranges), ["part", "column"])
    return joined.select("column", "category", (inside + F.col("offset")).alias("code"))


def fold_of(id_columns: tuple[str, ...], folds: int, seed: int) -> Column:
    """A fold from the md5 digest of the seed and the id's text."""
    texts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in id_columns]
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), 1, 13)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def _target_sums(df: DataFrame, step: TargetMean) -> DataFrame:
    """column, category, and by fold the rows with a target and the sum of it. Combined before the shuffle."""
    [target] = _fields(df, (step.target,))
    if not isinstance(target.dataType, (T.NumericType, T.BooleanType)):
        raise FeatureError(f"target '{step.target}' is neither a number nor a boolean")
    _fields(df, step.id_columns)
    cells = F.array(*[col(n).cast("string") for n in step.columns])
    taught = df.select(
        F.posexplode(cells).alias("column", "category"),
        fold_of(step.id_columns, step.folds, step.seed).alias("fold"),
        col(step.target).cast("double").alias("y"),
    ).filter("y IS NOT NULL AND NOT isnan(y)")
    each = taught.groupBy("column", "category", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    by_fold = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(x))), F.lit(0).cast(kind)) for k in range(step.folds)])
        for x, kind in (("n", "bigint"), ("s", "double"))
    ]
    return each.groupBy("column", "category").agg(by_fold[0].alias("n"), by_fold[1].alias("s"))


def fit_step(df: DataFrame, step: Step, fitted_on: str | None = None) -> FittedStep:
    """Learn a step from a frame. The frame is read once or a few times, however many columns there are."""
    _fields(df, step.columns)
    if isinstance(step, Impute):
        return FittedStep(step, {"values": _fillings(df, step)}, fitted_on)
    if isinstance(step, Scale):
        return FittedStep(step, {"lines": _lines(df, step)}, fitted_on)
    if isinstance(step, OneHot):
        found = most_frequent(category_counts(df, step.columns), step.limit)
        return FittedStep(step, {"categories": [found.get(i, []) for i in range(len(step.columns))]}, fitted_on)
    if isinstance(step, Ordinal):
        counts = stage(category_counts(df, step.columns))
        table = numbered(counts).join(counts, ["column", "category"])
        table = stage(table.select("column", "category", "code", "rows"))
        return FittedStep(step, {"rows": _rows(table)}, fitted_on, table)
    if step.folds < 2 or step.smoothing < 0:
        raise FeatureError("out-of-fold means take two folds or more and a smoothing that is not negative")
    rows = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    table = stage(_target_sums(df, step).withColumn("rows", rows))
    first = table.filter(F.col("column") == 0)
    folds = range(step.folds)
    sums = first.agg(*[F.sum(F.get("n", F.lit(k))) for k in folds], *[F.sum(F.get("s", F.lit(k))) for k in folds]).first()
    state = {"rows": _rows(table), "n": [x or 0 for x in sums[: step.folds]], "s": [x or 0.0 for x in sums[step.folds :]]}
    return FittedStep(step, state, fitted_on, table)


def _rows(table: DataFrame) -> int:
    return table.filter(F.col("column") == 0).agg(F.sum("rows")).first()[0] or 0


def _fillings(df: DataFrame, step: Impute) -> list:
    if step.strategy not in IMPUTE:
        raise FeatureError(f"unknown strategy '{step.strategy}'; there are {', '.join(IMPUTE)}")
    if step.strategy == "constant":
        return [step.value] * len(step.columns)
    if step.strategy == "mode":
        shown = df.select(*[_present(df, n).alias(n) for n in step.columns])
        found = most_frequent(category_counts(shown, step.columns), 1)
        return [found.get(i, [None])[0] for i in range(len(step.columns))]
    finite, statistics = _numbers(df, step.columns)
    if step.strategy == "mean":
        return [s["mean"] for s in statistics]
    medians = quantiles(finite, statistics, (0.5,))
    return [medians[n][0] for n in step.columns]


def _lines(df: DataFrame, step: Scale) -> list[list[float | None]]:
    """Per column what is subtracted and what is divided by (null: a constant or empty column)."""
    if step.method not in SCALE:
        raise FeatureError(f"unknown method '{step.method}'; there are {', '.join(SCALE)}")
    finite, statistics = _numbers(df, step.columns)
    if step.method == "standard":
        pairs = [(s["mean"], s["stddev"]) for s in statistics]
    elif step.method == "min_max":
        pairs = [(s["low"], s["high"] - s["low"] if s["finite"] else None) for s in statistics]
    else:
        found = quantiles(finite, statistics, QUARTILES)
        pairs = [(q[1], q[2] - q[0] if q[0] is not None else None) for q in (found[n] for n in step.columns)]
    return [[shift, unit or None] for shift, unit in pairs]


def _present(df: DataFrame, name: str) -> Column:
    """The value of a column, null where it is NaN."""
    value = col(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(value), value) if floating else value


def apply_step(df: DataFrame, fitted: FittedStep, training: bool = False) -> DataFrame:
    """The frame with the step's columns replaced or added. `training` says that it is the frame the
    step was fitted on."""
    step, state = fitted.step, fitted.state
    _fields(df, step.columns)
    if isinstance(step, Impute):
        return df.withColumns({n: _filled(df, n, v, step) for n, v in zip(step.columns, state["values"])})
    if isinstance(step, Scale):
        return df.withColumns({n: _scaled(n, *line) for n, line in zip(step.columns, state["lines"])})
    if isinstance(step, OneHot):
        return _one_hot(df, step, state["categories"])
    for i, name in enumerate(step.columns):
        if isinstance(step, Ordinal):
            df = _looked_up(df, fitted, i, name, "code", F.lit(None).cast("int"))
            found = F.when(col(name).isNotNull(), F.coalesce("__found", F.lit(-1).cast("bigint")))
        else:
            fold = fold_of(step.id_columns, step.folds, step.seed) if training else F.lit(None).cast("int")
            df = _looked_up(df, fitted, i, name, "struct(n, s)", fold)
            found = _smoothed(F.col("__found"), F.col("__fold"), step, state)
        df = df.withColumn(name, found).drop("__found", "__fold")
    return df


def _filled(df: DataFrame, name: str, value, step: Impute) -> Column:
    kind = "double" if step.strategy in ("mean", "median") else df.schema[name].dataType
    return F.coalesce(_present(df, name).cast(kind), F.lit(value).cast(kind))


def _scaled(name: str, shift: float | None, unit: float | None) -> Column:
    value = col(name).cast("double")
    if shift is None:
        return F.lit(None).cast("double")
    return (value - F.lit(shift)) / F.lit(unit) if unit else F.when(value.isNotNull(), 0.0)


def _one_hot(df: DataFrame, step: OneHot, categories: list[list[str]]) -> DataFrame:
    added = {}
    for name, known in zip(step.columns, categories):
        value = col(name).cast("string")
        added |= {f"{name}={c}": F.coalesce(value == c, F.lit(False)).cast("int") for c in known}
        others = value.isNotNull() & ~value.isin(known) if known else value.isNotNull()
        added[f"{name}=*"] = others.cast("int")
    clash = sorted(set(added) & set(df.columns))
    if clash:
        raise FeatureError(f"columns that are already there: {', '.join(clash)}")
    return df.withColumns(added).drop(*[n for n in step.columns])


def _looked_up(df: DataFrame, fitted: FittedStep, i: int, name: str, what: str, fold: Column) -> DataFrame:
    """`df` with __found, what the table says of the category, and __fold.

    Categories of more than a HOT-th of the rows, of which there are at most HOT, come from a broadcast
    table. The others are joined by value. Rows that need no such join are dealt by hash."""
    table = fitted.table.filter(F.col("column") == i).select("category", "rows", F.expr(what).alias("found"))
    many = F.col("rows") > fitted.state["rows"] / HOT
    hot = table.filter(many).select(F.col("category").alias("__hot"), F.struct("found").alias("__known"))
    cold = table.filter(~many & F.col("category").isNotNull()).select(
        F.col("category").alias("__cold"), F.lit(0).alias("__salt"), F.col("found").alias("__other")
    )
    rest = table.filter(~many & F.col("category").isNull()).select(F.col("found").alias("__null"))
    text = col(name).cast("string")
    dealt = df.withColumn("__fold", fold).withColumn("__text", text)
    dealt = dealt.join(F.broadcast(hot), F.col("__text").eqNullSafe(F.col("__hot")) & F.col("__known").isNotNull(), "left")
    by_value = F.col("__known").isNull() & F.col("__text").isNotNull()
    row = F.pmod(F.xxhash64(*[col(c) for c in df.columns if not _has_map(df.schema[c].dataType)]), F.lit(SALTS)).cast("int")
    dealt = dealt.withColumn("__key", F.when(by_value, F.col("__text"))).withColumn("__deal", F.when(by_value, 0).otherwise(row))
    joined = dealt.join(cold, (F.col("__key") == F.col("__cold")) & (F.col("__deal") == F.col("__salt")), "left")
    null_row = rest.first()  # one row at most
    found = F.coalesce(F.col("__known.found"), F.col("__other"))
    if null_row is not None:
        found = F.when(F.col("__text").isNull(), _literal(null_row["__null"])).otherwise(found)
    made = ("__text", "__hot", "__known", "__key", "__deal", "__cold", "__salt", "__other")
    return joined.withColumn("__found", found).drop(*made)


def _literal(found) -> Column:
    if isinstance(found, int):
        return F.lit(found).cast("bigint")
    return F.struct(F.lit(found["n"]).cast("array<bigint>").alias("n"), F.lit(found["s"]).cast("array<double>").alias("s"))


def _has_map(data_type: T.DataType) -> bool:
    """Whether values hold a map or a variant, which have no hash."""
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()


def _smoothed(found: Column, fold: Column, step: TargetMean, state: dict) -> Column:
    def total(xs: Column, kind: str) -> Column:
        whole = F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x)
        return F.coalesce(whole - F.coalesce(F.get(xs, fold), F.lit(0).cast(kind)), F.lit(0).cast(kind))

    def known(values: list, kind: str) -> Column:
        return total(F.lit(values).cast(f"array<{kind}>"), kind)

    n, s = total(found["n"], "bigint"), total(found["s"], "double")
    every, overall = known(state["n"], "bigint"), known(state["s"], "double")
    prior = F.when(every > 0, overall / every)
    weight = n + F.lit(float(step.smoothing))
    return F.when(weight > 0, (s + prior * step.smoothing) / weight).otherwise(prior)


@dataclass(frozen=True)
class FeaturePipeline:
    """Fitted steps in order."""

    steps: tuple[FittedStep, ...]

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """`df` after all steps; `training` if it is the frame that they were fitted on."""
        for fitted in self.steps:
            df = apply_step(df, fitted, training)
        return df

    def to_json(self) -> str:
        return json.dumps([s.described() for s in self.steps])

    def save_tables(self, folder: str) -> None:
        """Write the category tables, one folder per step that has one."""
        for i, fitted in enumerate(self.steps):
            if fitted.table is not None:
                fitted.table.write.parquet(f"{folder}/step{i}")

    @classmethod
    def from_json(cls, spark: SparkSession, text: str, folder: str) -> FeaturePipeline:
        steps = []
        for i, d in enumerate(json.loads(text)):
            lists = {k: tuple(v) if isinstance(v, list) else v for k, v in d["step"].items()}
            step = KINDS[d["kind"]](**lists)
            table = spark.read.parquet(f"{folder}/step{i}") if isinstance(step, (Ordinal, TargetMean)) else None
            steps.append(FittedStep(step, d["state"], d["fitted_on"], table))
        return cls(tuple(steps))


def fit_features(df: DataFrame, steps: list[Step], fitted_on: str | None = None) -> FeaturePipeline:
    """Fit each step on the frame as the steps before leave it. Hand over the training part only:
    `fitted_on` is the id of that dataset."""
    fitted: list[FittedStep] = []
    for step in steps:
        step = replace(step, columns=tuple(step.columns))
        fitted.append(fit_step(df, step, fitted_on))
        df = apply_step(df, fitted[-1], training=True)
    return FeaturePipeline(tuple(fitted))
