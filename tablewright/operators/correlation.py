"""Pearson correlations: a full matrix in one scan, or many columns against one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, col

# Of the rows that both columns of a pair have: how many, how many of them NaN or infinite, means,
# sums of squared deviations and of their products, and the ranges.
MOMENTS = ("n", "broken", "mx", "my", "vx", "vy", "c", "xlow", "xhigh", "ylow", "yhigh")
MOMENT_SCHEMA = "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)


def correlation_pairs(df: DataFrame, statistics: list[dict]) -> DataFrame:
    """Rows (row_name, column_name, r) for each pair of columns, upper triangle only.

    Nulls are dropped pair by pair. A pair with a constant side, or with NaN or infinities among
    its common rows, has no correlation. Each task reduces its rows to the moments of each pair,
    about the means of the rows that the pair has in common, and only those are shuffled: large
    means, or gaps that leave a cluster far from a column's mean, cost no digits.
    """
    names = [s["field"].name for s in statistics]
    numbers = [as_double(name).alias(f"v{i}") for i, name in enumerate(names)]
    parts = df.select(*numbers).mapInArrow(_pair_moments(), MOMENT_SCHEMA).filter("n > 0")
    # One row per task and pair. The deviations of a task's means from the common ones are summed
    # up, which the difference of two sums of squares would not give.
    pair = Window.partitionBy("i", "j")
    common = parts.select(
        "*",
        *[(F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair)).alias(f"all_{m}") for m in ("mx", "my")],
    )
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    totals = common.groupBy("i", "j").agg(
        F.sum("broken").alias("broken"),
        F.sum(F.col("vx") + F.col("n") * dx * dx).alias("vx"),
        F.sum(F.col("vy") + F.col("n") * dy * dy).alias("vy"),
        F.sum(F.col("c") + F.col("n") * dx * dy).alias("c"),
        *[F.min(m).alias(m) for m in ("xlow", "ylow")],
        *[F.max(m).alias(m) for m in ("xhigh", "yhigh")],
    )
    varied = (F.col("xlow") < F.col("xhigh")) & (F.col("ylow") < F.col("yhigh"))
    r = F.try_divide("c", F.sqrt("vx") * F.sqrt("vy"))
    labels = F.array(*[F.lit(n) for n in names])
    return totals.select(
        F.get(labels, F.col("i")).alias("row_name"),
        F.get(labels, F.col("j")).alias("column_name"),
        F.when((F.col("broken") == 0) & varied, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"),
    )


def _pair_moments():
    """The per-task reduction. A nested function travels to the executors by value, so they need
    not have this package installed."""
    names = MOMENTS

    def of_batch(raw, known):
        """An array of a matrix per moment. Columns with the same gaps share their common rows, so
        they are taken together: one matrix product if no column of the batch has gaps."""
        width = raw.shape[1]
        out = np.zeros((len(names), width, width))
        fine = np.isfinite(raw)
        values = np.where(fine, raw, 0.0)
        groups = {}
        for i in range(width):
            groups.setdefault(known[:, i].tobytes(), []).append(i)
        groups = list(groups.values())
        for a in groups:
            for b in groups:
                rows = known[:, a[0]] & known[:, b[0]]
                n = int(rows.sum())
                if not n:
                    continue
                x, y = (values[np.ix_(rows, g)] for g in (a, b))
                bad = ~fine[np.ix_(rows, a)], ~fine[np.ix_(rows, b)]
                mx, my = x.mean(0), y.mean(0)
                dx, dy = x - mx, y - my
                tall, wide = np.ones((len(a), 1)), np.ones((1, len(b)))
                parts = (
                    n * tall * wide,
                    bad[0].sum(0)[:, None] * wide + tall * bad[1].sum(0)[None, :],
                    mx[:, None] * wide,
                    tall * my[None, :],
                    (dx * dx).sum(0)[:, None] * wide,
                    tall * (dy * dy).sum(0)[None, :],
                    dx.T @ dy,
                    x.min(0)[:, None] * wide,
                    x.max(0)[:, None] * wide,
                    tall * y.min(0)[None, :],
                    tall * y.max(0)[None, :],
                )
                out[np.ix_(range(len(names)), a, b)] = np.stack(parts)
        return out

    def merged(p, q):
        """Moments of two sets of rows together."""
        n = p[0] + q[0]
        share = np.divide(q[0], n, out=np.zeros_like(n), where=n > 0)
        dx, dy = q[2] - p[2], q[3] - p[3]
        weight = p[0] * share
        out = p + q
        out[2], out[3] = p[2] + dx * share, p[3] + dy * share
        out[4] += weight * dx * dx
        out[5] += weight * dy * dy
        out[6] += weight * dx * dy
        for k, pick in ((7, np.minimum), (8, np.maximum), (9, np.minimum), (10, np.maximum)):
            out[k] = np.where(p[0] == 0, q[k], np.where(q[0] == 0, p[k], pick(p[k], q[k])))
        return out

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            known = np.column_stack([~np.asarray(c.is_null()) for c in batch.columns])
            found = of_batch(np.column_stack(columns).astype(float), known)
            total = found if total is None else merged(total, found)
        if total is None:
            return
        i, j = np.triu_indices(total.shape[1], k=1)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
        arrays += [pa.array(m[i, j]) for m in total]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *names])

    return reduce_batches


def correlations_with(df: DataFrame, features: list[T.StructField], target: str) -> DataFrame:
    """Rows (column, r): each feature against one target, nulls dropped pair by pair.

    Long form, one row per feature and table row, combined before the shuffle. It stays in
    generated code however many features there are; one aggregate per feature would not.
    """
    cells = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), as_double(f.name).alias("x"))
            for f in features
        ]
    )
    y = as_double(target)
    moments = (
        df.filter(col(target).isNotNull())
        .select(y.alias("y"), F.inline(cells))
        .filter("x IS NOT NULL")
        .groupBy("column")
        .agg(
            F.covar_pop("x", "y").alias("cov"),
            F.stddev_pop("x").alias("dx"),
            F.stddev_pop("y").alias("dy"),
        )
    )
    r = F.try_divide("cov", F.col("dx") * F.col("dy"))
    return moments.select("column", F.when(~F.isnan(r), r).alias("r"))
