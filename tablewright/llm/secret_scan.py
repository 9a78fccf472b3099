"""Secrets in texts: fixed patterns, and strings that a battery of tests can't tell from random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns. `assign` drops matches whose second group has under 6 characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: A whole run of encoding characters with a letter and a digit, and its padding.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])"
    r"[A-Za-z0-9+/_-]{20,}={0,2}"
)
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encoding, its characters in order of value, and a pattern for the whole string. First fit wins.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", "^[0-9a-f]+$"),
    ("HEX", DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    ("base32", UPPER + "234567", "^[A-Z2-7]+=*$"),
    ("base36", DIGITS + LOWER, "^[0-9a-z]+$"),
    ("BASE36", DIGITS + UPPER, "^[0-9A-Z]+$"),
    ("base62", DIGITS + UPPER + LOWER, "^[0-9A-Za-z]+$"),
    ("base64", UPPER + LOWER + DIGITS + "+/", "^[0-9A-Za-z+/]+=*$"),
    ("base64url", UPPER + LOWER + DIGITS + "-_", "^.*$"),
)
#: A secret must be able to hold this many bits.
LEAST_BITS = 80
#: Bounds of the length classes that get false-discovery control of their own.
LENGTH_CLASSES = (24, 32, 48, 64, 128, 512)
#: p-values are counted in bins of equal width in log10, down to 10 to the power -FLOOR.
BINS_PER_DECADE, FLOOR = 20, 12
#: Matches of a text that are folded together, see `_running`.
TOGETHER = 256
#: Share of random strings among those cleared as ordinary.
FALSE_DISCOVERIES = 0.05


def _running(rows: Column, ahead, step, none: Column) -> Column:
    """What a fold over `rows` puts out, for arrays of any length.

    `step` takes the state (at, out) and a row, `ahead` the place before a chunk of rows and the
    chunk, and gives the place after it. A fold copies its output with each row, so rows are folded
    in chunks of TOGETHER, each from the place that the chunks before it lead to.
    """

    def chunked(rows: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / TOGETHER).cast("int"))
        return _let(F.transform(cuts, lambda i: F.slice(rows, i * TOGETHER + 1, F.lit(TOGETHER))), placed)

    def placed(chunks: Column) -> Column:
        places = F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda s, chunk: F.struct(
                ahead(s["at"], chunk).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")
            ),
            lambda s: s["out"],
        )
        return _let(
            places,
            lambda at: F.flatten(
                F.transform(
                    chunks,
                    lambda chunk, i: F.aggregate(
                        chunk, F.struct(at[i].alias("at"), none.alias("out")), step, lambda s: s["out"]
                    ),
                )
            ),
        )

    return _let(rows, lambda held: F.when(F.size(held) > 0, chunked(held)).otherwise(none))


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, part): where the matches are, and what the group holds.

    Matches and the pieces between them come from the same pattern, so their lengths add up to
    positions in code points, in one pass over the text.
    """
    wanted = F.lit(pattern)
    matches = F.regexp_extract_all(text, wanted, F.lit(0))
    parts = matches if group == 0 else F.regexp_extract_all(text, wanted, F.lit(group))
    pieces = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,part:string>>)")
    rows = F.arrays_zip(
        matches.alias("whole"), parts.alias("part"), F.slice(pieces, F.lit(1), F.size(matches)).alias("before")
    )

    def length(r: Column) -> Column:
        return F.length(r["before"]) + F.length(r["whole"])

    found = _running(
        rows,
        lambda at, chunk: F.aggregate(chunk, at, lambda n, r: n + length(r)),
        lambda s, r: F.struct(
            (s["at"] + F.length(r["before"]) + F.length(r["whole"])).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        (s["at"] + F.length(r["before"])).alias("start"),
                        (s["at"] + F.length(r["before"]) + F.length(r["whole"])).alias("end"),
                        r["part"].alias("part"),
                    )
                ),
            ).alias("out"),
        ),
        none,
    )
    return F.when(F.regexp_like(text, wanted), found).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind, leftmost and not overlapping within the kind."""
    assign = F.filter(_spans(text, ASSIGN, 2), lambda s: F.length(s["part"]) >= 6)
    return {"assign": assign, "access": _spans(text, ACCESS), "hex": _spans(text, HEX)}


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to seven digits (a known polynomial approximation)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _squared_counts(values: Column) -> Column:
    """Sum of the squared counts of equal values."""
    return F.aggregate(
        F.array_sort(values),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, x: _let(
            F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1.0)),
            lambda run: F.struct(x.alias("last"), run.alias("run"), (s["sum"] + 2 * run - 1).alias("sum")),
        ),
        lambda s: s["sum"],
    )


def randomness(symbols: Column, letters: Column) -> Column:
    """p-value of the battery for a string given as symbol values below `letters`.

    Three tests of the hypothesis that symbols are drawn evenly and independently: chi-squared
    against even use of the alphabet (upper tail, exact mean and variance), the number of runs
    above and below the middle of the alphabet, and the correlation of each symbol with the next.
    Their p-values are combined by Fisher's method.
    """
    return _let(
        F.struct(symbols.alias("v"), F.size(symbols).cast("double").alias("n"), letters.cast("double").alias("k")),
        lambda s: _battery(s["v"], s["n"], s["k"]),
    )


def _battery(symbols: Column, n: Column, k: Column) -> Column:
    chi = _squared_counts(symbols) * k / n - n
    p_chi = _let(
        (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
        lambda z: F.when(z > 0, _normal_tail(z)).otherwise(1 - _normal_tail(-z)),
    )

    # One pass for the runs and the moments; x is centred on the middle of the alphabet.
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(-1).alias("side"), zero.alias("x"), zero.alias("runs"), zero.alias("high"),
        zero.alias("sum"), zero.alias("squares"), zero.alias("next"), zero.alias("first"),
    )
    moments = F.aggregate(
        symbols,
        start,
        lambda s, v: _let(
            F.struct(
                (v - (k - 1) / 2).alias("x"),
                F.when(v * 2 >= k, 1).otherwise(0).alias("side"),
            ),
            lambda c: F.struct(
                c["side"].alias("side"),
                c["x"].alias("x"),
                (s["runs"] + F.when(s["side"] == c["side"], 0.0).otherwise(1.0)).alias("runs"),
                (s["high"] + c["side"]).alias("high"),
                (s["sum"] + c["x"]).alias("sum"),
                (s["squares"] + c["x"] * c["x"]).alias("squares"),
                (s["next"] + s["x"] * c["x"]).alias("next"),
                F.when(s["side"] < 0, c["x"]).otherwise(s["first"]).alias("first"),
            ),
        ),
    )

    def scores(m: Column) -> Column:
        both = 2 * m["high"] * (n - m["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        mean = m["sum"] / n
        variance = m["squares"] - n * mean * mean
        # The sum of (x_i - mean)(x_i+1 - mean) over neighbours.
        lagged = m["next"] - mean * (2 * m["sum"] - m["first"] - m["x"]) + (n - 1) * mean * mean
        return F.array(
            F.when(spread > 0, F.abs(m["runs"] - both / n - 1) / F.sqrt(spread)),
            F.when(variance > 0, F.abs(lagged / variance + 1 / n) * F.sqrt(n)),
        )

    def fisher(z: Column) -> Column:
        logs = F.aggregate(
            z,
            -F.log(F.greatest(p_chi, F.lit(1e-18))),
            lambda sum_, x: sum_ - F.log(2 * _normal_tail(F.least(F.coalesce(x, F.lit(8.0)), F.lit(8.0)))),
        )
        return _let(logs, lambda x: F.least(F.exp(-x) * (1 + x + x * x / 2), F.lit(1.0)))

    return _let(moments, lambda m: _let(scores(m), fisher))


def candidates(text: Column) -> Column:
    """Array of (start, end, encoding, length_class, bin): strings of an encoding that could hold
    a secret, with the bin of their p-value; the lower the bin, the less random."""
    def described(span: Column) -> Column:
        code = F.coalesce(
            *[F.when(F.regexp_like(span["part"], F.lit(p)), F.lit(i)) for i, (_, _, p) in enumerate(ENCODINGS)]
        )
        return _let(
            F.struct(code.alias("code"), F.rtrim(span["part"], F.lit("=")).alias("body")),
            lambda c: F.struct(
                span["start"].alias("start"),
                span["end"].alias("end"),
                c["code"].alias("encoding"),
                F.size(F.filter(F.array(*[F.lit(b) for b in LENGTH_CLASSES]), lambda b: b <= F.length(c["body"]))).alias(
                    "length_class"
                ),
                (F.length(c["body"]) * F.log2(F.length(_alphabet(c["code"])).cast("double"))).alias("bits"),
                _bin(
                    randomness(
                        F.transform(F.split(c["body"], ""), lambda x: F.instr(_alphabet(c["code"]), x) - 1),
                        F.length(_alphabet(c["code"])),
                    )
                ).alias("bin"),
            ),
        )

    return F.filter(F.transform(_spans(text, CANDIDATE), described), lambda c: c["bits"] >= LEAST_BITS)


def _alphabet(code: Column) -> Column:
    return F.array(*[F.lit(letters) for _, letters, _ in ENCODINGS])[code]


def _bin(p: Column) -> Column:
    scaled = F.floor(F.log10(F.greatest(p, F.lit(10.0**-FLOOR))) * BINS_PER_DECADE) + FLOOR * BINS_PER_DECADE
    return scaled.cast("int")


def ordinary_bins(text_rows: DataFrame, text: Column) -> dict[tuple[int, int], int]:
    """For each (encoding, length class) the highest bin whose strings count as ordinary, or -1.

    Benjamini-Hochberg within the class: of its m p-values the i-th smallest is rejected as not
    random up to the last i with p_i <= level * i / m; a bin counts with its upper edge. The
    counts are summed per bin before they meet, and there are at most encodings x classes x bins
    of them, whatever the input.
    """
    counts = (
        text_rows.select(F.explode(candidates(text)).alias("c"))
        .groupBy("c.encoding", "c.length_class", "c.bin")
        .count()
    )
    group = Window.partitionBy("encoding", "length_class")
    ranked = counts.withColumn("i", F.sum("count").over(group.orderBy("bin"))).withColumn(
        "m", F.sum("count").over(group)
    )
    edge = F.pow(F.lit(10.0), (F.col("bin") + 1) / F.lit(float(BINS_PER_DECADE)) - FLOOR)
    rejected = ranked.filter(edge <= FALSE_DISCOVERIES * F.col("i") / F.col("m"))
    rows = rejected.groupBy("encoding", "length_class").agg(F.max("bin").alias("bin")).collect()
    return {(r["encoding"], r["length_class"]): r["bin"] for r in rows}


def find_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with `secrets`, an array of (start, end, kind), added or replaced.

    Positions count code points, the end is exclusive, the order is by start and then kind as in
    KINDS. Kinds assign, access and hex come from patterns; `random` marks further strings, apart
    from those spans, that contain letters and digits, fit an encoding, could hold LEAST_BITS
    bits, and are not found ordinary by `ordinary_bins` over all of `docs`. A null text is empty.
    No shuffle but that of the counts; two passes over the texts.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    ordinary = ordinary_bins(docs, text)
    limits = F.lit(None).cast("map<int,int>")
    if ordinary:
        pairs = [F.lit(x) for (e, n), b in ordinary.items() for x in (e * 100 + n, b)]
        limits = F.create_map(*pairs)
    base = base_spans(text)
    fixed = F.concat(*[_of_kind(spans, i) for i, spans in enumerate(base.values())])

    def all_spans(known: Column) -> Column:
        kept = F.filter(
            candidates(text),
            lambda c: (c["bin"] > F.coalesce(limits[c["encoding"] * 100 + c["length_class"]], F.lit(-1)))
            & ~F.exists(known, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])),
        )
        return F.array_sort(F.concat(known, _of_kind(kept, 3)))

    names = F.array(*[F.lit(k) for k in KINDS])
    found = F.transform(
        _let(fixed, all_spans),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["kind"]].alias("kind")),
    )
    return docs.withColumn("secrets", found)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mask. Null stays null."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    # What stays: from the furthest end so far to each start beyond it, and the rest.
    between = _running(
        spans,
        lambda at, chunk: F.greatest(at, F.array_max(F.transform(chunk, lambda x: x["end"]))),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when((x["end"] <= s["at"]) | (x["start"] < s["at"]), s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), x["start"].alias("end")))))
            .alias("out"),
        ),
        none,
    )

    def cut(pieces: Column) -> Column:
        """Pieces by chunk, from the part of the text that the chunk spans: a place in a text is
        found by walking there from its start."""
        cuts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / TOGETHER).cast("int"))

        def chunk_text(chunk: Column) -> Column:
            first, last = chunk[0]["start"], F.element_at(chunk, -1)["end"]
            return _let(
                F.substring(text, first + 1, last - first),
                lambda part: F.transform(
                    chunk, lambda x: F.concat(F.substring(part, x["start"] - first + 1, x["end"] - x["start"]), F.lit(mask))
                ),
            )

        kept = F.flatten(
            F.transform(cuts, lambda i: _let(F.slice(pieces, i * TOGETHER + 1, F.lit(TOGETHER)), chunk_text))
        )
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        rest = F.substring(text, end + 1, F.length(text))
        return F.when(F.size(pieces) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(rest)

    return F.when(F.size(spans) > 0, _let(between, cut)).otherwise(text)
