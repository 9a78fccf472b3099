"""Judging URLs by host and path rules, found through short hash prefixes of URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hex digits of a digest that the join compares first.
SHORT = 8
#: Rule tables up to this many bytes (rows times the widest row) are sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Copies of a larger rule table, so that the rows of one hot expression meet in that many tasks.
SALTS = 32

RULE_SCHEMA = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. A null URL or one without `://` has neither: both are empty texts."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    slash = F.instr(after, "/")
    host = F.when(slash > 0, F.substring(after, F.lit(1), slash - 1)).otherwise(after)
    path = F.when(slash > 0, F.substring(after, slash, F.length(after))).otherwise(F.lit(""))
    return F.translate(host, UPPER, UPPER.lower()), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    url_column: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`urls` with the columns host, path, rule and verdict.

    `rules` has host, path and verdict. A rule fits its host and all subdomains of it if the path
    of the URL starts with the rule's path. Of several the longest wins, then `block` before
    `allow`. `rule` is the text of the winning rule, host and path, or null where none fits; such
    a URL gets `default`. Rules without host or verdict fit nothing, a null path is empty.

    A URL is expanded into one expression for each suffix of its host and each length that rule
    paths have. The expressions meet the rules on the first hex digits of their SHA-256 digest;
    the whole digest then decides. A rule table of a checked size is broadcast, a larger one is
    dealt out in salted copies, so that an expression that most URLs share burdens no single task.
    Every row of `urls` is kept, repeated rows too; columns of the same names are replaced.
    """
    host, path = url_parts(F.col(f"`{url_column}`"))
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in urls.columns if c not in made or c == url_column]
    base = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        host.alias("host"),
        path.alias("path"),
    )
    known = (
        rules.filter((F.col("host") != "") & F.col("verdict").isNotNull())
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy(F.concat("host", "path").alias("rule"), F.length("path").alias("reach"))
        .agg(F.max("verdict").alias("verdict"))  # block before allow
        .withColumn("digest", _digest(F.col("rule")))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    rule_count, widest, lengths = known.agg(
        F.count(F.lit(1)), F.max(F.octet_length("rule") + 128), F.collect_set("reach")
    ).first()
    hits = _hits(base.select("host", "path").distinct(), known, sorted(lengths),
                 rule_count * (widest or 0) <= broadcast_bytes)
    out = base.join(hits, ["host", "path"], "left")
    return out.select(
        *[F.col("row")[c].alias(c) for c in kept if c not in made],
        *[F.col("row")[c].alias(c) for c in kept if c in made],
        *[F.col(c) for c in ("host", "path", "rule") if c not in kept],
        *([] if "verdict" in kept else [F.coalesce("verdict", F.lit(default)).alias("verdict")]),
    )


def _hits(places: DataFrame, known: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """The winning rule of each (host, path) that a rule fits. Rule paths have these lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    reaches = F.filter(
        F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
        lambda n: n <= F.length(F.col("path")),
    )
    asked = (
        places.withColumn("suffix", F.explode(suffixes))
        .withColumn("reach", F.explode(reaches))
        .withColumn("full", _digest(F.expr("concat(suffix, substring(path, 1, reach))")))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    keys = ["short", "reach"]
    if small:
        known = F.broadcast(known)
    else:
        keys.append("salt")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    found = asked.join(known, keys).filter(F.col("full") == F.col("digest"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule")))
    return (
        found.groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
