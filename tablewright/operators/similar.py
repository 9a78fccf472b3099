"""Rows of one table that nearly equal a row of another: close numbers, few differing categories.

Locality-sensitive buckets that lose no pair:

* The numbers of a row, each divided by its scale, are projected on random unit vectors. A projection is
  never longer than the distance, so rows within a distance of one fall in the same or in neighbouring
  cells of width one, on every vector.
* If at most d categories may differ, the categories are dealt to d + 1 groups. Of two similar rows, at
  least one group is the same throughout.

A bucket is a group's values with a cell. Before that, rows are put in finer boxes of equal categories,
so small that all rows of a box are similar: dense regions and copies are settled there by a plain
equi-join. Only rows that find no company in their box look through buckets, and a semi-join stops at
the first similar row, so no table of pairs is ever made.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, comparable, hash128
from tablewright.functions.kinds import NUMERIC, kind_of
from tablewright.functions.staging import stage
from tablewright.operators.overlap import aligned

#: Projections that make a cell; a row looks in three cells on each.
PROJECTIONS = 2
#: Cells are a little wider than one, boxes a little smaller, so that rounding errors lose and add no pair.
WIDTH, SHRINK = 1.01, 1 - 1e-6
#: Scaled numbers beyond this size have too few digits left for a box.
LARGE = 1e9


def _vectors(size: int, seed: int) -> list[list[float]]:
    draw = random.Random(seed)
    vectors = []
    for _ in range(min(PROJECTIONS, size)):
        raw = [draw.gauss(0, 1) for _ in range(size)]
        norm = math.sqrt(sum(x * x for x in raw))
        vectors.append([x / norm for x in raw])
    return vectors


def _contents(df: DataFrame, scales: Sequence[float]) -> DataFrame:
    """The rows of `df`, of which the columns n0, n1, ... are compared, numbers first, with their key
    (k1, k2), `state` (which numbers are null, NaN or infinite), `x`, the scaled numbers, zero where
    they are none, and `c`, hashes of the categories."""
    states, numbers, hashed = [], [], []
    compared = [c for c in df.columns if c != "row"]
    for name, scale in zip(compared, scales):
        value = F.col(name).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        states.append(F.when(finite, F.lit("number")).otherwise(F.coalesce(value.cast("string"), F.lit("null"))))
        numbers.append(F.when(finite, value / F.lit(float(scale))).otherwise(F.lit(0.0)))
    for name in compared[len(scales) :]:
        h0, h1 = hash128([comparable(df.schema[name])])
        hashed.append(F.struct(h0.alias("h0"), h1.alias("h1")))
    rows = df.select(
        *[c for c in df.columns if c == "row"],
        F.xxhash64(F.lit(0), *states).alias("state"),
        F.array(*numbers).cast("array<double>").alias("x"),
        F.array(*hashed).cast("array<struct<h0:bigint,h1:bigint>>").alias("c"),
    )
    k1, k2 = hash128([F.col("state"), F.col("x"), F.col("c")])
    return rows.select("*", k1.alias("k1"), k2.alias("k2"))


def _box(size: int) -> list[Column]:
    """Two hashes of the box of a row. Its side is the longest whose diagonal is shorter than one."""
    side = SHRINK / math.sqrt(max(size, 1))
    corners = F.transform(
        "x",
        lambda v: F.when(F.abs(v) < LARGE, F.struct(F.lit(0).alias("raw"), F.floor(v / side).cast("double").alias("v")))
        .otherwise(F.struct(F.lit(1).alias("raw"), v.alias("v"))),
    )
    b1, b2 = hash128([F.col("state"), F.col("c"), corners])
    return [b1.alias("b1"), b2.alias("b2")]


def _cells(vectors: list[list[float]]) -> list[Column]:
    """The cell of a row on each vector."""
    cells = []
    for vector in vectors:
        length = reduce(lambda a, b: a + b, [F.get("x", F.lit(i)) * F.lit(u) for i, u in enumerate(vector)])
        # Cut off numbers keep their order and come no further apart, so neighbours stay neighbours.
        kept = F.least(F.greatest(length, F.lit(-1e15)), F.lit(1e15))
        cells.append(F.floor(kept / F.lit(WIDTH)))
    return cells


def _buckets(groups: list[list[int]], cells: list[Column]) -> Column:
    """One struct of two hashes for each group of categories."""
    found = []
    for number, members in enumerate(groups):
        own = [F.get("c", F.lit(i)) for i in members]
        p1, p2 = hash128([F.lit(number), F.col("state"), *own, *cells])
        found.append(F.struct(p1.alias("p1"), p2.alias("p2")))
    return F.array(*found)


def similar_rows(
    test: DataFrame,
    train: DataFrame,
    scales: Mapping[str, float],
    categories: Sequence[str] = (),
    differing: int = 0,
    seed: int = 0,
) -> DataFrame:
    """`test` with a boolean column `similar`: whether train has a row that is near in the numbers and
    differs in `differing` of the categories at most.

    `scales` gives for each number the difference that counts as one; near is a Euclidean distance of
    one at most over all of them. Nulls, NaN and infinities are near their own kind only, and a null
    category equals a null. Any seed gives the same result, exact while numbers are below 1e12 scales.
    Other columns are carried along; one called `similar` is replaced. An empty train has nothing similar.
    """
    if not scales and not categories:
        raise ValueError("similar rows need a number or a category to compare")
    if any(not (0 < s < float("inf")) for s in scales.values()):
        raise ValueError("scales are finite and above zero")
    if differing < 0 or (differing and differing >= len(categories)):
        raise ValueError("differing is at least zero and less than the number of categories")
    if set(scales) & set(categories):
        raise ValueError("a column is a number or a category, not both")
    wrong = [n for n in scales if kind_of(test.schema[n].dataType) != NUMERIC]
    if wrong:
        raise ValueError(f"not a number: {', '.join(wrong)}")

    names, sizes = [*scales, *categories], list(scales.values())
    theirs, ours = aligned(test.select(*[col(n) for n in names]), train.select(*[col(n) for n in names]))
    row = F.struct(*[col(c) for c in test.columns if c != "similar"]).alias("row")
    # Both sides are compared in types that hold the values of both.
    common = [col(n).cast(theirs.schema[n].dataType).alias(f"n{i}") for i, n in enumerate(names)]
    keyed = _contents(test.select(row, *common), sizes)
    asked = keyed.drop("row").dropDuplicates(["k1", "k2"])
    known = _contents(ours.select(*[col(n).alias(f"n{i}") for i, n in enumerate(names)]), sizes)
    known = known.dropDuplicates(["k1", "k2"])
    box = _box(len(scales))
    asked = stage(asked.select("*", *box))
    known = stage(known.select("*", *box))

    boxes = known.select("b1", "b2").distinct()
    settled = asked.join(boxes, ["b1", "b2"], "left_semi").select("k1", "k2")
    opened = stage(asked.join(boxes, ["b1", "b2"], "left_anti"))

    groups = [list(range(i, len(categories), differing + 1)) for i in range(differing + 1)]
    cells = _cells(_vectors(len(scales), seed))
    steps = [F.array(*[F.lit(i) for i in ways]) for ways in product((-1, 0, 1), repeat=len(cells))]
    looking = opened.withColumn("cell", F.array(*cells)).withColumn("step", F.explode(F.array(*steps)))
    around = [F.get("cell", F.lit(i)) + F.get("step", F.lit(i)) for i in range(len(cells))]
    seeking = looking.select("k1", "k2", "x", "c", F.inline(_buckets(groups, around))).alias("s")
    offered = known.select(F.col("x").alias("y"), F.col("c").alias("d"), F.inline(_buckets(groups, cells))).alias("o")
    square = F.aggregate(
        F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v
    )
    changed = F.size(F.filter(F.zip_with("c", "d", lambda a, b: a != b), lambda v: v))
    near = (square <= 1) & (changed <= differing)
    same = (F.col("s.p1") == F.col("o.p1")) & (F.col("s.p2") == F.col("o.p2"))
    met = seeking.join(offered, same & near, "left_semi").select("k1", "k2").distinct()

    hits = settled.unionByName(met).withColumn("similar", F.lit(True))
    joined = keyed.select("row", "k1", "k2").join(hits, ["k1", "k2"], "left")
    return joined.select("row.*", F.coalesce("similar", F.lit(False)).alias("similar"))
