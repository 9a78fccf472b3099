"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.staging import drop_table, stage


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node it is linked to, for every node with a link.

    `links` has two columns of one type that can be ordered. Large-star and small-star steps in
    turn: first every node hands its larger neighbours to its smallest one, then its smaller ones.
    The table of links never grows, and the number of rounds grows with the logarithm of the
    number of nodes, however long the chains are. Every round is written to the staging folder, and
    the one before it goes.
    A node of very many links is a skewed join key, which adaptive execution splits.
    """
    a, b = links.columns[:2]
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    edges = stage(both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    seen = _state(edges)
    while seen[0]:
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        least = least.select("k", F.least("k", "m").alias("m"))
        # Each link (u, v), u > v, once from either end: v joins the least of u only if v > u.
        larger = edges.join(least, edges["v"] == least["k"]).select("u", F.col("m").alias("v"))
        larger = larger.filter("u <> v").distinct()
        lower = larger.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        met = larger.join(lower, larger["u"] == lower["k"])
        smaller = met.select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct("u", F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v")
        before, edges = edges, stage(smaller.filter("u <> v").distinct())
        drop_table(before)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the links: equal for equal tables."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.bit_xor(F.xxhash64("u", "v")),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
    ).first()
    return tuple(row)
