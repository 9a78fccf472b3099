"""Mixing sources to target weights by hash-seeded Poisson repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.staging import stage

#: A mean above this is drawn as a sum of several means, for exp(-mean) must stay above zero.
LARGEST_MEAN = 256.0
#: Distribution values kept beyond the mean, in standard deviations, and at least; what is left
#: is below the resolution of the draws.
DEVIATIONS, LEAST = 12, 40
#: Tables of up to so many sources, of at most some 4 kB each, are sent to every executor.
BROADCAST_SOURCES = 2_000
#: Hex digits of a digest that make a draw: 52 bits, all exact in a double.
DRAW_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of texts; equal texts give equal numbers."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """One row per source: its documents and the sum of their sizes. Null is a source, too."""
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.coalesce(size.cast("bigint"), F.lit(0))).alias("size"),
    )


def tempered_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """Weights in proportion to a power of the size: below 1 it lifts small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def repetition_means(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """Source and the mean number of copies that gives it its share of `epochs` times all sizes.

    A source without a weight, of weight null or below zero, or of size zero, gets mean zero.
    """
    given = weights.groupBy(F.col("source").alias("to")).agg(F.sum("weight").alias("weight"))
    joined = sizes.join(given, F.col("source").eqNullSafe(F.col("to")), "left").select(
        "source", "size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")
    )
    totals = joined.agg(
        F.sum("size").cast("double").alias("all"),
        F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weights"),
    )
    share = F.col("weight") / F.col("weights")
    mean = F.when(
        (F.col("size") > 0) & (F.col("weights") > 0), F.lit(epochs) * F.col("all") * share / F.col("size")
    ).otherwise(F.lit(0.0))
    # One row of totals, whatever the input.
    return joined.join(F.broadcast(totals)).select("source", mean.alias("mean"))


def poisson_tables(means: DataFrame) -> DataFrame:
    """Source, `parts` and the distribution function of Poisson(mean / parts), as an array."""
    parts = F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int")
    rate = F.col("rate")
    last = (F.floor(rate + DEVIATIONS * F.sqrt(rate)) + LEAST).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(
            F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf")
        ),
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            (s["sum"] + s["p"] * rate / k).alias("sum"),
            F.concat(s["cdf"], F.array(s["sum"] + s["p"] * rate / k)).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    return (
        means.withColumn("parts", parts)
        .withColumn("rate", F.col("mean") / F.col("parts"))
        .select("source", "parts", steps.alias("cdf"))
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    size: Column | None = None,
    exponent: float = 0.7,
    epochs: float = 1.0,
    seed: int = 0,
    partitions: int | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in a global random order.

    `weights` has source and weight; without it the weights are the sizes to the power `exponent`.
    A document of a source of mean m appears as often as a Poisson variable of mean m says. The
    variable is the inverse distribution function at a number drawn from the digest of seed, id
    and text, so a rerun, a lost executor or another file layout changes nothing. Equal rows get
    equal counts. A null id or text is drawn like an empty one.

    The columns `replica` (0, 1, ...) and `shuffle_key` (the place in the global order, in [0, 1))
    are added or replaced. Rows are dealt to partitions by a digest of all of that, and sorted
    within them by the key. The size is by default the number of characters.
    """
    size = F.length(F.col(f"`{text_column}`")) if size is None else size
    own = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    sizes = stage(source_sizes(docs, size, source_column))
    means = repetition_means(sizes, tempered_weights(sizes, exponent) if weights is None else weights, epochs)
    tables = poisson_tables(means).filter(F.col("cdf")[0] < 1)  # mean zero: no copies at all
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.col(f"`{source_column}`").alias("of"),
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("content"),
    )
    tables = tables.select(F.struct("source").alias("held"), "parts", "cdf")
    if sizes.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    met = row.join(tables, F.struct(F.col("of").alias("source")) == F.col("held"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda j: uniform(F.lit(str(seed)), F.col("id"), F.col("content"), j.cast("string")),
    )
    copies = F.aggregate(
        draws,
        F.lit(0),
        lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u)),
    )
    counted = met.withColumn("copies", copies).filter(F.col("copies") > 0).drop("cdf", "held")
    repeated = counted.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = uniform(F.lit(f"order {seed}"), F.col("id"), F.col("content"), F.col("replica").cast("string"))
    ordered = repeated.withColumn("shuffle_key", key)
    dealt = ordered.repartition(*([partitions] if partitions else []), "shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key").select("row.*", "replica", "shuffle_key")
