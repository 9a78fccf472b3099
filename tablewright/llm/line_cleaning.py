"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much text.

A line is judged by its own words and marks (symbols, shouting, navigation bars, fragments without
a closing mark, boilerplate, one word over and over) and goes too if it copies an earlier line of its
text. A document is rejected if more than a share of its words went, or if it fails the base rules:
too few words, or too many in word windows that repeat. All of it is SQL functions on one row:
nothing is shuffled, and the work on a text grows with n log n of its length, for repeats are found
by sorting windows and lines, not by comparing each with all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\x09-\\x0D]+"
SPACES = " \\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
#: Marks that set the links of a menu apart.
BARS = "|•·»›"
#: A line that ends so is a sentence, or quotes one.
CLOSING = ".!?…\"')]:;。！？”’»"
#: Phrases of notices that come with a page and not with its text.
NOTICES = (
    "licensed under",
    "all rights reserved",
    "copyright",
    "cookie",
    "privacy policy",
    "terms of use",
    "terms of service",
    "javascript",
    "lorem ipsum",
)
#: Words in a window that counts as repeated.
WINDOW = 3
#: Bits for a place beside the bits of a hash in one number.
PLACE_BITS = 24
#: Least words of a document, and most percent of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Most percent of the words that lines may take with them.
MOST_LOST = 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of some characters, a regular expression, a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more, the first included.

    Windows are sorted as numbers, hash before place. Where windows of different words share a hash,
    or there are too many, they are sorted by their words."""

    def inside(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]

    def place(p: Column) -> Column:
        return p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def key(p: Column) -> Column:
        return F.shiftright(p, PLACE_BITS)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: _hash(inside(w, i)))

    def by_number(w: Column, s: Column) -> Column:
        found = F.filter(
            s,
            lambda p, j: F.coalesce(key(p) == key(F.get(s, j - 1)), F.lit(False))
            | F.coalesce(key(p) == key(F.get(s, j + 1)), F.lit(False)),
        )

        def checked(r: Column) -> Column:
            def differs(p: Column, j: Column) -> Column:
                before = F.get(r, j - 1)
                pairs = zip(inside(w, place(p)), inside(w, place(before)))
                other = F.lit(False)
                for x, y in pairs:
                    other = other | (x != y)
                return F.coalesce((key(p) == key(before)) & other, F.lit(False))

            alike = ~F.array_contains(F.transform(r, differs), True)
            return F.when(alike, _covered(F.transform(r, place))).otherwise(by_words(w))

        return _let(found, checked)

    def by_words(w: Column) -> Column:
        def window(i: Column) -> Column:
            return F.struct(*[x.alias(f"w{k}") for k, x in enumerate(inside(w, i))], i.alias("i"))

        def same(x: Column, y: Column) -> Column:
            equal = F.lit(True)
            for k in range(WINDOW):
                equal = equal & (x[f"w{k}"] == y[f"w{k}"])
            return F.coalesce(equal, F.lit(False))

        def places(s: Column) -> Column:
            found = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
            return _covered(F.filter(found, lambda i: i.isNotNull()))

        return _let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)), places)

    def compared(w: Column, h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("bigint"))))
        return (
            F.when(F.size(F.array_distinct(h)) == F.size(h), 0)
            .when(F.size(h) <= F.lit(1 << PLACE_BITS), _let(packed, lambda s: by_number(w, s)))
            .otherwise(by_words(w))
        )

    def counted(w: Column) -> Column:
        return F.when(F.size(w) >= WINDOW, _let(hashes(w), lambda h: compared(w, h))).otherwise(0)

    return _let(words, counted)


def _covered(places: Column) -> Column:
    """How many words the windows at some places cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sort_array(places),
        start,
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )


def failed_rule(line: Column, words: Column, copy: Column) -> Column:
    """The first rule that a line with words fails, or null."""
    n = F.size(words)
    capitals = ~line.rlike("[a-z]") & line.rlike("[A-Z]{2}")
    closed = F.lit(CLOSING).contains(F.right(F.element_at(words, -1), F.lit(1)))

    def noticed(lowered: Column) -> Column:
        found = F.lit(False)
        for phrase in NOTICES:
            found = found | lowered.contains(phrase)
        return found

    return (
        F.when(10 * count_of(line, SYMBOLS + "!") > 3 * n, "symbols")
        .when((n >= 5) & capitals, "shouting")
        .when(_let(count_of(line, BARS), lambda bars: (bars >= 3) & (4 * bars > n)), "navigation")
        .when((n < 5) & ~closed, "fragment")
        .when(_let(F.lower(line), noticed), "boilerplate")
        .when((n >= 20) & (5 * F.size(F.array_distinct(words)) < n), "repetition")
        .when(copy, "copy")
    )


def judged_lines(text: Column) -> Column:
    """The lines of a text in order: place i, line, n words, copy (of an earlier line), rule (failed)."""
    placed = F.sort_array(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i"))))

    def compared(s: Column) -> Column:
        def copied(x: Column, j: Column) -> Column:
            again = F.coalesce(F.get(s, j - 1)["line"] == x["line"], F.lit(False))
            return F.struct(x["i"].alias("i"), x["line"].alias("line"), again.alias("copy"))

        return F.sort_array(F.transform(s, copied))

    def judged(x: Column) -> Column:
        def of(w: Column) -> Column:
            rule = F.when(F.size(w) > 0, failed_rule(x["line"], w, x["copy"]))
            return F.struct(
                x["i"].alias("i"), x["line"].alias("line"), F.size(w).alias("n"), x["copy"].alias("copy"), rule.alias("rule")
            )

        return _let(words_of(x["line"]), of)

    return F.transform(_let(placed, compared), judged)


def clean_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
    most_lost: int = MOST_LOST,
) -> DataFrame:
    """Per row the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, lost_words, failed (the rule of each line that went, in order) and cleaned (the rest).

    A null or empty text has no words and fails. Lines without a word never fail and stay. A
    document is kept if it passes the base rules and no more than `most_lost` percent of its words
    were in lines that went. Every row counts, repeated rows too; an empty table gives no rows;
    other columns are left out. Memory grows with the longest text.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    found = docs.select(
        F.col(f"`{id_column}`").alias(id_column),
        (F.length(text) - count_of(text, SPACES)).alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        _let(
            words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))
        ).alias("words"),
        _let(judged_lines(text), _summary).alias("lines"),
    )
    n, repeated = F.col("words.n").cast("bigint"), F.col("words.repeated").cast("bigint")
    base_failed = (n < least_words) | (100 * repeated > most_repeated * n)
    lost = F.col("lines.lost").cast("bigint")
    return found.select(
        id_column,
        n.alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        F.col("lines.copies").cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (100 * lost <= most_lost * n)).alias("kept"),
        lost.alias("lost_words"),
        F.col("lines.failed").alias("failed"),
        F.col("lines.cleaned").alias("cleaned"),
    )


def _summary(lines: Column) -> Column:
    gone = F.filter(lines, lambda x: x["rule"].isNotNull())
    stay = F.filter(lines, lambda x: x["rule"].isNull())
    return F.struct(
        F.size(F.filter(lines, lambda x: x["copy"] & (x["n"] > 0))).alias("copies"),
        F.aggregate(gone, F.lit(0), lambda a, x: a + x["n"]).alias("lost"),
        F.transform(gone, lambda x: x["rule"]).alias("failed"),
        F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("cleaned"),
    )
