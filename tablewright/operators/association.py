"""Association beyond straight lines: Spearman's rank correlation, Cramér's V, mutual information.

Ranks of all columns come from one table of distinct values and their counts, sorted in ranges: a
value's rank is what lies in the ranges before, plus the running sum inside its range, plus half of
its own count. No task sees a whole column, and a value that fills a third of it is one row. Nulls
leave a pair's rows, so a column is ranked anew for every pattern of gaps among its partners; columns
without gaps, or with the same ones, share theirs.

Contingency tables of all pairs are one grouping of cells by hashes of their categories; margins and
sums are further groupings of the cells, which never leave Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_double, col, hash128
from tablewright.functions.kinds import is_floating, kind_of, NUMERIC
from tablewright.functions.staging import drop_table, stage
from tablewright.operators.quantiles import quantiles
from tablewright.operators.scalars import scalar_statistics

#: Values that hold more than a HOT-th of the rows are broadcast with their ranks: HOT per column at most.
HOT = 1000
#: Different values of columns, counted by class, whose ranks tasks look up (16 bytes each): those of the fewest values first.
HELD = 1 << 20
#: Columns of more values that rows are joined with, one after the other, before they are written.
TOGETHER = 8
MATRIX = "row_name string, column_name string, r double"


def _numeric(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    fields = [df.schema[c] for c in columns] if columns else [f for f in df.schema if kind_of(f.dataType) == NUMERIC]
    wrong = [f.name for f in fields if kind_of(f.dataType) != NUMERIC]
    if wrong:
        raise ValueError(f"columns that are no numbers: {', '.join(wrong)}")
    return fields


def _sortable(field: T.StructField) -> Column:
    """A number in its order, whole numbers as such and others as double; null where it is null or NaN."""
    if isinstance(field.dataType, T.IntegralType):
        return col(field.name).cast("bigint")
    number = as_double(field.name)
    return F.when(~F.isnan(number), number + F.lit(0.0))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of doubles without NaN as 64-bit whole numbers of the same order, one to one."""
    for batch in batches:
        columns = []
        for column in batch.columns:
            if pa.types.is_floating(column.type):
                bits = column.fill_null(0.0).to_numpy(zero_copy_only=False).view(np.int64)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                column = pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=~there)
            columns.append(column)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_name, column_name, r of all pairs of numeric columns, both ways round, and 1 with itself.

    Ranks are averages over ties and count within the rows that a pair has in common: null and NaN
    are gaps, infinities the first and last values. r is null for pairs with a constant side or
    fewer than two common rows. The frame is written once with a number for each row; work grows
    with the number of columns times that of different patterns of gaps. Tasks look up the ranks of
    columns with few different values; a column of many takes one equi-join. Empty below two columns.
    """
    fields = _numeric(df, columns)
    spark = df.sparkSession
    if len(fields) < 2:
        return spark.createDataFrame([], MATRIX)
    names = [f"c{i}" for i in range(len(fields))]
    cells = df.select(*[_sortable(f).alias(n) for f, n in zip(fields, names)])
    cells = cells.mapInArrow(_ordered, ", ".join(f"{n} bigint" for n in names))
    rows = stage(cells.withColumn("id", F.monotonically_increasing_id()))
    classes = _gap_classes(rows, names)
    count = max(classes) + 1
    shown = [classes.index(k) for k in range(count)]
    keyed = F.array(
        *[F.when(F.col(names[s]).isNotNull(), F.col(n)) for n in names for s in shown]
    )  # column i among the rows of class k at i * count + k
    long = rows.select(F.posexplode(keyed).alias("key", "v")).filter("v IS NOT NULL")
    ranks = stage(average_ranks(long.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))))
    found = {r.key: r for r in ranks.groupBy("key").agg(F.sum("n").alias("n"), F.count("v").alias("kinds")).collect()}
    sizes = {key: r.n for key, r in found.items()}
    centre = F.lit([(sizes.get(k, 0) + 1) / 2 for k in range(len(names) * count)])
    centred = ranks.select("key", "v", "n", (F.col("rank") - F.get(centre, F.col("key"))).alias("d"))
    squares = {r.key: r.q for r in centred.groupBy("key").agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("q")).collect()}
    kinds = [sum(found[k].kinds for k in range(i * count, (i + 1) * count) if k in found) for i in range(len(names))]
    large, room = [], HELD
    for i in sorted(range(len(names)), key=lambda i: kinds[i]):
        room -= kinds[i]
        if room < 0:
            large.append(i)
    # Of all keys of a column, that of its own class has the most rows of a value.
    own = F.get(F.lit([k % count == classes[k // count] for k in range(len(names) * count)]), F.col("key"))
    many = own & (F.col("n") > max(sizes.values(), default=0) / HOT)
    column = F.floor(F.col("key") / count).cast("int").alias("i")
    hot = stage(centred.filter(many & column.isin(large)).select(column, "v"))
    each = centred.select("key", "v", "d", column).join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["i", "v"], "left")
    looked = each.filter(~F.col("i").isin(large) | F.col("hot")).select("key", "v", "d")
    tables = spark.sparkContext.broadcast(_lookup(looked))
    cold = each.filter("hot IS NULL")
    products = _with_ranks(rows, names, large, count, cold, hot).drop("id")
    multiply = _rank_products(classes, shown, large, tables)
    sums = products.mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    products_of = {(r.i, r.j): r.s for r in sums.collect()}  # one per pair
    found = [(f.name, f.name, 1.0) for f in fields]
    for i, j in combinations(range(len(fields)), 2):
        spread = (squares.get(i * count + classes[j]) or 0.0) ** 0.5 * (squares.get(j * count + classes[i]) or 0.0) ** 0.5
        r = max(-1.0, min(1.0, products_of.get((i, j), 0.0) / spread)) if spread else None
        found += [(fields[i].name, fields[j].name, r), (fields[j].name, fields[i].name, r)]
    tables.destroy()
    for table in (ranks, rows, hot):
        drop_table(table)
    return spark.createDataFrame(found, MATRIX)


def _lookup(ranks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each key its values in order and their centred ranks; HELD of them at most, and HOT a key."""
    found = ranks.toArrow()
    key, v, d = (found[c].to_numpy() for c in ("key", "v", "d"))
    order = np.lexsort((v, key))
    key, v, d = key[order], v[order], d[order]
    keys, starts = np.unique(key, return_index=True)
    ends = [*starts[1:], len(key)]
    return {int(k): (v[a:b], d[a:b]) for k, a, b in zip(keys, starts, ends)}


def _with_ranks(rows: DataFrame, names: list[str], large: list[int], count: int, cold: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with an array `d{i}`, for each large column i, of its centred ranks by class.

    Rows go from one join to the next, so each moves once for a column and is never put together
    again; after TOGETHER columns the ranks are written and joined by row. Gaps and frequent values
    have no partner there: they are spread by row, and looked up later.
    """
    frequent = {r.i for r in hot.select("i").distinct().collect()}
    done: list[DataFrame] = []
    for low in range(0, len(large), TOGETHER):
        some = large[low : low + TOGETHER]
        part = rows if not low else rows.select("id", *[names[i] for i in some])
        for i in some:
            by_class = F.array(*[F.max(F.when(F.col("key") == i * count + k, F.col("d"))) for k in range(count)])
            of = cold.filter(F.col("i") == i)
            of = of.groupBy("v").agg(by_class.alias(f"d{i}")) if count > 1 else of.select("v", F.array("d").alias(f"d{i}"))
            spread = F.col(names[i]).isNull()
            if i in frequent:
                there = hot.filter(F.col("i") == i).select(F.col("v").alias(names[i]), F.lit(True).alias("held"))
                part = part.join(F.broadcast(there), names[i], "left")
                spread = spread | F.col("held").isNotNull()
            place = F.when(spread, F.col("id").bitwiseAND(F.lit((1 << 20) - 1)) + 1).otherwise(F.lit(0))
            part = part.withColumns({"v": F.coalesce(names[i], F.lit(0)), "place": place})
            part = part.join(of.withColumn("place", F.lit(0).cast("bigint")), ["v", "place"], "left").drop("v", "place", "held")
        done.append(part if not low else part.select("id", *[f"d{i}" for i in some]))
    if len(done) < 2:
        return done[0] if done else rows
    return reduce(lambda x, y: x.join(y, "id"), [stage(part) for part in done])


def _gap_classes(rows: DataFrame, names: list[str]) -> list[int]:
    """The class of each column; columns with values in the same rows are of one class."""
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(n).alias(n) for n in names]).first()
    full = (sizes["rows"], "all")
    found = {i: full if sizes[n] == sizes["rows"] else (sizes[n],) for i, n in enumerate(names)}
    gaps = [i for i, n in enumerate(names) if 0 < sizes[n] < sizes["rows"]]
    if len(gaps) > 1:
        cells = F.array(*[F.when(F.col(names[i]).isNotNull(), F.lit(i)) for i in gaps])
        marks = [F.xxhash64("id", F.lit(k)).alias(f"m{k}") for k in range(2)]
        each = rows.select(*marks, F.explode(cells).alias("i")).filter("i IS NOT NULL")
        digests = [F.bit_xor(f"m{k}").alias(f"x{k}") for k in range(2)]
        found |= {r.i: (sizes[names[r.i]], r.x0, r.x1) for r in each.groupBy("i").agg(*digests).collect()}
    numbers: dict = {}
    return [numbers.setdefault(found[i], len(numbers)) for i in range(len(names))]


def average_ranks(counts: DataFrame) -> DataFrame:
    """`counts`, rows (int key, v, n, ...) of distinct values v of each key, with their average `rank`."""
    ranged = counts.repartitionByRange("key", "v").sortWithinPartitions("key", "v")
    placed = stage(ranged.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33).cast("int"))
    upto: dict[int, int] = {}
    offsets = []
    for r in sorted(placed.groupBy("part", "key").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.key, r.part)):
        offsets.append((r.part, r.key, upto.get(r.key, 0)))  # a range and key each: ranges plus keys at most
        upto[r.key] = upto.get(r.key, 0) + r.n
    before = counts.sparkSession.createDataFrame(offsets, "part int, key int, before bigint")
    inside = Window.partitionBy("part", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n").over(inside), F.lit(0))
    found = placed.withColumn("running", running).join(F.broadcast(before), ["part", "key"])
    return found.select(*counts.columns, (F.col("before") + F.col("running") + (F.col("n") + 1) / 2).alias("rank"))


def _rank_products(classes: list[int], shown: list[int], large: list[int], tables: Broadcast):
    """The per-task sums of products of centred ranks, pairs of columns taken class by class."""
    count = len(shown)
    members = [[i for i, c in enumerate(classes) if c == k] for k in range(count)]

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        ranks = np.zeros((len(classes) * count, batch.num_rows))
        there = [batch.column(f"c{i}").is_valid().to_numpy(zero_copy_only=False) for i in range(len(classes))]
        for i in range(len(classes)):
            cells = batch.column(f"c{i}").fill_null(0).to_numpy(zero_copy_only=False)
            for k, other in enumerate(shown):
                values, ds = tables.value.get(i * count + k, (None, None))
                if values is not None:
                    at = np.minimum(np.searchsorted(values, cells), len(values) - 1)
                    ranks[i * count + k] = np.where(there[i] & there[other] & (values[at] == cells), ds[at], 0.0)
            if i in large:
                joined = batch.column(f"d{i}")
                at = np.flatnonzero(joined.is_valid().to_numpy(zero_copy_only=False))
                ds = joined.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, count)
                for k, other in enumerate(shown):
                    ranks[i * count + k, at] = ds[:, k] * there[other][at]
        return ranks

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(classes), len(classes)))
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = centred(batch)
            for k, a in enumerate(members):
                for m, b in enumerate(members):
                    one, other = ([i * count + c for i in g] for g, c in ((a, m), (b, k)))
                    total[np.ix_(a, b)] += ranks[one] @ ranks[other].T
        i, j = np.triu_indices(len(classes), k=1)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "s"])

    return multiply


def _category(field: T.StructField, cuts: dict[str, list[float | None]]) -> Column:
    """What a value counts as: itself, or for fractions the quartile that it lies in."""
    if not is_floating(field.dataType):
        return col(field.name)
    value = as_double(field.name)
    edges = [e for e in cuts[field.name] if e is not None]
    quarter = F.lit(0)
    for edge in edges:
        quarter = quarter + (value > F.lit(edge)).cast("int")
    return F.when(value.isNotNull() & ~F.isnan(value), quarter)


def contingency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """i, j, a, b, n: how many rows have a category a of column i (by hash) and b of column j, i < j."""
    fields = [df.schema[c] for c in columns or df.columns]
    fractions = [f for f in fields if is_floating(f.dataType)]
    cuts = {}
    if fractions:
        finite = df.select(*[F.when(~F.isnan(as_double(f.name)), as_double(f.name)).alias(f.name) for f in fractions])
        cuts = quantiles(finite, scalar_statistics(finite, finite.schema.fields)[1])
    hashes = []
    for f in fields:
        category = _category(f, cuts)
        hashes.append(F.when(category.isNotNull(), F.struct(*hash128([category]))))
    coded = df.select(F.array(*hashes).alias("h"))
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("h", F.lit(i)).alias("a"), F.get("h", F.lit(j)).alias("b"))
            for i, j in combinations(range(len(fields)), 2)
        ]
    )
    each = coded.select(F.inline(pairs)).filter("a IS NOT NULL AND b IS NOT NULL")
    return each.groupBy("i", "j", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def associations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_name, column_name, rows, cramers_v and mutual_information (natural logarithm) of all pairs.

    Every value is a category but fractions, which count by quartile; null and NaN are gaps, left out
    pair by pair. Cramér's V is null where a side has one category. Pairs without common rows are
    left out. Empty below two columns.
    """
    names = columns or df.columns
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "row_name string, column_name string, rows bigint, cramers_v double, mutual_information double")
    cells = stage(contingency(df, names))
    pair = ["i", "j"]
    sides = {s: cells.groupBy(*pair, s).agg(F.sum("n").alias(f"n_{s}")) for s in ("a", "b")}
    size = sides["a"].groupBy(*pair).agg(F.sum("n_a").alias("rows"), F.count(F.lit(1)).alias("ka"))
    size = size.join(sides["b"].groupBy(*pair).agg(F.count(F.lit(1)).alias("kb")), pair)  # one row per pair
    each = cells.join(sides["a"], [*pair, "a"]).join(sides["b"], [*pair, "b"]).join(F.broadcast(size), pair)
    n, rows = F.col("n").cast("double"), F.col("rows").cast("double")
    margins = F.col("n_a").cast("double") * F.col("n_b")
    sums = each.groupBy(*pair, "rows", "ka", "kb").agg(
        F.sum(n * n / margins).alias("phi"), F.sum(n / rows * F.ln(n * rows / margins)).alias("mutual")
    )
    least = F.least("ka", "kb") - 1
    v = F.sqrt(F.greatest(F.col("phi") - 1, F.lit(0.0)) / least)
    labels = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.get(labels, F.col("i")).alias("row_name"),
        F.get(labels, F.col("j")).alias("column_name"),
        "rows",
        F.when(least > 0, F.least(v, F.lit(1.0))).alias("cramers_v"),
        F.greatest("mutual", F.lit(0.0)).alias("mutual_information"),
    )
