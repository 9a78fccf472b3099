"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A table has three parts of PART cells. The 64-bit digest of a paragraph goes to one cell of each
part; a cell holds how many digests it got, their exclusive or, and that of their check values. The
difference of the tables of two texts holds the paragraphs that only one of them has. Peeling gets
them back: a cell with one digest gives it away, and is subtracted from the other parts. If too
many differ for that, the tables are built anew, larger: the digests are dealt to so many tables of
the same form that each is likely to hold few.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tablewright.functions.staging import stage

PARTS, PART = 3, 8
CELLS = PARTS * PART
#: Rounds of peeling; tables that still give digests after that count as too small.
ROUNDS = 24
#: Paragraphs of both texts per table when tables are built anew; halved with each further try.
PER_TABLE = 12
#: After that many tries the digests themselves are compared.
TRIES = 4
#: Documents that are sorted together to find each one's successor, and ranges of ids at most.
TOGETHER, RANGES, STEP = 2_000, 1 << 16, 1 << 8


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """The distinct digests (k) of the lines of a text, with a hash of each (g). Never empty."""
    digests = F.array_distinct(F.transform(F.split(text, "\n"), lambda p: F.xxhash64(p)))
    return F.transform(digests, lambda k: F.struct(k.alias("k"), F.xxhash64(k).alias("g")))


def _cell_of(g: Column) -> Column:
    """The three cells of a digest, numbered through all parts."""
    return F.array(
        *[(F.shiftrightunsigned(g, 3 * j).bitwiseAND(F.lit(PART - 1)) + PART * j).cast("int") for j in range(PARTS)]
    )


def _check(g: Column) -> Column:
    return F.shiftrightunsigned(g, 32)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("bigint").alias("k"), c.cast("bigint").alias("c"))


def table_of(digests: Column) -> Column:
    """The cells of digests as `paragraphs` gives them."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def cells(placed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(CELLS - 1)),
            lambda i: F.aggregate(
                placed,
                zero,
                lambda s, d: F.when(
                    F.array_contains(d["at"], i),
                    _cell(s["n"] + 1, s["k"].bitwiseXOR(d["k"]), s["c"].bitwiseXOR(_check(d["g"]))),
                ).otherwise(s),
            ),
        )

    placed = F.transform(
        digests, lambda d: F.struct(d["k"].alias("k"), d["g"].alias("g"), _cell_of(d["g"]).alias("at"))
    )
    return _let(placed, cells)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])),
    )


def peel(cells: Column) -> Column:
    """The digests in a difference of tables, as an array of (k, n), n being 1 if the first text
    has it and -1 if the second; null if they can't all be got back."""
    empty = F.expr("cast(array() as array<struct<k:bigint,n:int>>)")

    def alone(cell: Column) -> Column:
        return (F.abs(cell["n"]) == 1) & (_check(F.xxhash64(cell["k"])) == cell["c"])

    def one_round(s: Column, pure: Column) -> Column:
        known = F.transform(
            pure, lambda d: F.struct(d["k"].alias("k"), d["n"].alias("n"), F.xxhash64(d["k"]).alias("g"))
        )
        placed = F.transform(
            known,
            lambda d: F.struct(
                d["k"].alias("k"), d["n"].alias("n"), _check(d["g"]).alias("c"), _cell_of(d["g"]).alias("at")
            ),
        )
        rest = _let(
            placed,
            lambda all_: F.transform(
                s["cells"],
                lambda cell, i: F.aggregate(
                    all_,
                    cell,
                    lambda x, d: F.when(
                        F.array_contains(d["at"], i),
                        _cell(x["n"] - d["n"], x["k"].bitwiseXOR(d["k"]), x["c"].bitwiseXOR(d["c"])),
                    ).otherwise(x),
                ),
            ),
        )
        return F.struct(
            rest.alias("cells"), F.concat(s["found"], pure).alias("found"), F.lit(True).alias("live")
        )

    def step(s: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(F.filter(s["cells"], alone), lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))
        )
        stopped = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("live"))
        return F.when(
            s["live"], _let(pure, lambda p: F.when(F.size(p) > 0, one_round(s, p)).otherwise(stopped))
        ).otherwise(s)

    start = F.struct(cells.alias("cells"), empty.alias("found"), F.lit(True).alias("live"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(
        done,
        lambda s: F.when(
            ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0)), s["found"]
        ),
    )


def as_text(cells: Column, count: Column) -> Column:
    """The fingerprint: number of distinct paragraphs, then the cells, in hex digits."""

    def digits(x: Column, width: int) -> Column:
        return F.lpad(F.hex(x.cast("bigint")), width, "0")

    body = F.transform(cells, lambda c: F.concat(digits(c["n"], 4), digits(c["k"], 16), digits(c["c"], 8)))
    return F.lower(F.concat(digits(count, 8), F.array_join(body, "")))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared over all distinct paragraphs, from the counts of both texts and of the difference."""
    shared = (a + b - differing) / 2
    return shared / (a + b - shared)


def differing_paragraphs(pairs: DataFrame) -> DataFrame:
    """`pair` and `differing`, an array of (k, n), for each row (pair, a, b) of paragraph arrays.

    Builds tables so large that they hold the differences, tries again with half as many
    paragraphs to a table where some can't be peeled, and at last compares the digests. The
    digests are dealt by pair and table, so no task gets all of a long text.
    """
    open_, done = pairs, None
    for attempt in range(TRIES):
        tables = F.greatest(F.ceil((F.size("a") + F.size("b")) * (1 << attempt) / PER_TABLE), F.lit(1))
        dealt = open_.select("pair", tables.alias("tables"), F.explode(_both()).alias("d")).select(
            "pair",
            F.pmod(F.xxhash64("d.g", F.lit(attempt)), F.col("tables")).alias("table"),
            "d",
        )
        held = dealt.groupBy("pair", "table").agg(F.collect_list("d").alias("ds"))
        side = [F.filter("ds", _is(True)), F.filter("ds", _is(False))]
        peeled = held.select("pair", peel(minus(table_of(side[0]), table_of(side[1]))).alias("found"))
        result = peeled.groupBy("pair").agg(
            F.flatten(F.collect_list("found")).alias("differing"), F.bool_and(F.col("found").isNotNull()).alias("whole")
        )
        result = stage(result)
        good = result.filter("whole").select("pair", "differing")
        done = good if done is None else done.union(good)
        failed = result.filter("not whole").select("pair")
        if failed.isEmpty():
            return done
        open_ = open_.join(failed, "pair")
    exact = F.concat(_only("a", "b", 1), _only("b", "a", -1))
    rest = open_.select("pair", exact.alias("differing"))
    return rest if done is None else done.union(rest)


def _both() -> Column:
    return F.concat(_sided("a", True), _sided("b", False))


def _sided(name: str, first: bool) -> Column:
    return F.transform(name, lambda d: F.struct(d["k"].alias("k"), d["g"].alias("g"), F.lit(first).alias("first")))


def _is(first: bool):
    return lambda d: d["first"] == F.lit(first)


def _only(name: str, other: str, n: int) -> Column:
    keys = F.array_except(F.col(name)["k"], F.col(other)["k"])
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))


def _range_key(docs: DataFrame) -> Column:
    """What the ids are cut into ranges by: a text by the seven bytes behind what all have in common."""
    kind = docs.schema["id"].dataType
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return F.col("id")
    if not isinstance(kind, StringType):
        raise TypeError(f"documents can't be put in order by ids of type {kind.simpleString()}")
    raw = F.encode("id", "utf-8")
    ends = docs.agg(F.min(raw), F.max(raw)).first()
    common = len(os.path.commonprefix([bytes(e) for e in ends])) if ends[0] is not None else 0
    digits = F.rpad(F.hex(F.substring(raw, common + 1, 7)), 14, "0")
    return F.conv(digits, 16, 10).cast("bigint")


def with_successor(docs: DataFrame) -> DataFrame:
    """`docs`, rows (id, text), with `next`: the text of the next row by id and text, after the
    last of the first. Ids are numbers, dates, times or texts; other types are an error.

    The ids are cut into ranges of about equally many rows, by approximate quantiles; each range
    is sorted in a task of its own, together with a copy of the first row of the next range. Null
    ids come first. Rows are shuffled once.
    """
    n = docs.count()
    parts = min(RANGES, n // TOGETHER)
    bounds: list = []
    key = _range_key(docs)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * parts))).first()[0] or []
        bounds = sorted(set(bounds))
    kind = docs.select(key.alias("key")).schema["key"].dataType.simpleString()
    if bounds:
        rough = F.array(*[F.lit(b) for b in bounds[::STEP]]).cast(f"array<{kind}>")
        fine = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
        inner = F.array(*[F.array(*map(F.lit, part)).cast(f"array<{kind}>") for part in fine])
        coarse = F.size(F.filter(rough, lambda b: b <= key))
        within = F.size(F.filter(inner[F.greatest(coarse - 1, F.lit(0))], lambda b: b <= key))
        place = F.when(coarse > 0, (coarse - 1) * STEP + within).otherwise(F.lit(0))
    else:
        place = F.lit(0)
    ranged = docs.withColumn("range", place.cast("int"))
    least = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("least")
    heads = sorted(ranged.groupBy("range").agg(least).collect(), key=lambda r: r["range"])  # RANGES at most
    before = {r["range"]: heads[i - 1]["range"] for i, r in enumerate(heads)}
    if not before:
        return docs.withColumn("next", F.col("text"))
    previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range")]
    # Of the rows with the least id of a range the one of the least text is copied.
    first_ids = docs.sparkSession.createDataFrame(
        [(r["range"], r["least"]["id"]) for r in heads], f"at int, first_id {docs.schema['id'].dataType.simpleString()}"
    )
    copies = (
        ranged.join(
            F.broadcast(first_ids), (F.col("range") == F.col("at")) & F.col("id").eqNullSafe(F.col("first_id"))
        )
        .groupBy("range", "id")
        .agg(F.min("text").alias("text"))
        .select("id", "text", previous.alias("range"), F.lit(True).alias("copy"))
    )
    rows = ranged.select("id", "text", "range", F.lit(False).alias("copy")).union(copies)
    by = Window.partitionBy("range").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead("text").over(by)).filter(~F.col("copy")).select("id", "text", "next")


def fingerprint_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row the id, n_chars, `edited` (the text with its last quarter replaced by the start of
    the next document), the fingerprints of both, near_edited and near_next.

    The next document is the next by id, and by text among equal ids; null ids come first and
    after the last row comes the first. A null text is empty. Likeness is shared over all distinct
    paragraphs, as recovered from the difference of two tables, 1 for equal sets of paragraphs.
    Every row counts, repeated rows too; other columns are left out.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    )
    n = F.length("text")
    edited = F.expr(
        "concat(substring(text, 1, length(text) - length(text) div 4), substring(next, 1, length(text) div 4))"
    )
    cut = with_successor(rows).withColumn("edited", edited)
    held = cut.select(
        "id",
        n.cast("bigint").alias("n_chars"),
        "edited",
        paragraphs(F.col("text")).alias("own"),
        paragraphs(F.col("edited")).alias("other"),
        paragraphs(F.col("next")).alias("after"),
    )
    tables = held.select(
        "*", *[table_of(F.col(c)).alias(f"{c}_table") for c in ("own", "other", "after")]
    )
    first = tables.select(
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own_table"), F.size("own")).alias("fingerprint"),
        as_text(F.col("other_table"), F.size("other")).alias("edited_fingerprint"),
        *[F.size(c).alias(f"{c}_count") for c in ("own", "other", "after")],
        F.coalesce(F.size(peel(minus(F.col("own_table"), F.col("other_table")))), F.lit(-1)).alias("d_other"),
        F.coalesce(F.size(peel(minus(F.col("own_table"), F.col("after_table")))), F.lit(-1)).alias("d_after"),
        "own",
        "other",
        "after",
    )
    sides = ("other", "after")
    first = first.select(
        *[c for c in first.columns if c not in ("own", *sides)],
        # Digests travel on only where a difference was too large.
        F.when(F.least("d_other", "d_after") < 0, F.col("own")).alias("own"),
        *[F.when(F.col(f"d_{c}") < 0, F.col(c)).alias(c) for c in sides],
    )
    first = stage(first.withColumn("row", F.monotonically_increasing_id()))
    pairs = first.select(
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.struct("row", F.lit(c).alias("side")).alias("pair"),
                            F.col("own").alias("a"),
                            F.col(c).alias("b"),
                        )
                        for c in sides
                    ]
                ),
                lambda p: p["b"].isNotNull(),
            )
        ).alias("p")
    ).select("p.pair", "p.a", "p.b")
    again = (
        differing_paragraphs(pairs)
        .groupBy("pair.row")
        .agg(*[F.max(F.when(F.col("pair.side") == c, F.size("differing"))).alias(f"again_{c}") for c in sides])
    )
    whole = first.drop("own", *sides).join(again, "row", "left")
    near = [
        likeness(
            F.col("own_count"),
            F.col(f"{c}_count"),
            F.when(F.col(f"d_{c}") >= 0, F.col(f"d_{c}")).otherwise(F.col(f"again_{c}")),
        )
        for c in sides
    ]
    return whole.select(
        F.col("id").alias(id_column),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near[0].alias("near_edited"),
        near[1].alias("near_next"),
    )
