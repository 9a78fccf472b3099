"""Removing repeated byte strings: longest-previous-factor arrays over buckets of a suffix order.

Whether the LENGTH bytes from a place on occur elsewhere is a matter of suffix order: the suffixes
with the same LENGTH bytes are neighbours in it, and the neighbour with the nearest smaller text
position is the earlier match. The order of all suffixes of a corpus is not built at once:

1. The suffixes are dealt to buckets. Of the GRAM-byte strings inside its first LENGTH bytes every
   suffix takes the one of the smallest hash, its anchor; equal LENGTH-byte strings have equal
   anchors at the same distance. So a bucket is an anchor's hash, and one anchor owns a run of
   suffixes, its context. Buckets of one context lead to no match and are left out.
2. Contexts of a bucket with the same 64-bit hash of their bytes, and the same distances to the anchor,
   are one class, of which one stands for all.
3. The suffixes of the classes of a bucket are sorted by prefix doubling to depth LENGTH. Of each, the
   nearest suffixes before and after it in that order with a smaller position are found; the longer
   of the two common prefixes is its longest previous factor, and where it comes from an earlier match.
   A factor of LENGTH bytes marks a copy. A bucket of very many classes, at the seam of a passage
   that many documents share, is not sorted in one task; its suffixes meet by two 64-bit hashes of
   their LENGTH bytes instead, which tells the same.
4. The spans of a class go to all its contexts. Classes that hold more than one of HEAVY parts of all
   contexts are HEAVY at most; they are broadcast, so that no task reads all contexts of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.staging import SMALL_BATCHES, drop_table, settings, stage
from tablewright.llm.decontaminate import row_key
from tablewright.llm.slots import SLOTS, slot_table, slots_of, unpacked

LENGTH, GRAM = 400, 64
#: Anchors are chosen among this many neighbouring places.
WIDTH = LENGTH - GRAM + 1
#: Bytes of a text looked at together; places must fit PLACE_BITS bits.
PIECE, PLACE_BITS = 1 << 18, 20
#: Classes of a bucket that are sorted in one task.
SORTED = 8192
#: Bytes of contexts that are sorted together.
TOGETHER = 1 << 18
#: A key with more than one of so many parts of all rows is joined by broadcast.
HEAVY = 4096

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = PIECE + LENGTH + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, _BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers()


def _sums(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64))
        )


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbouring bytes."""
    with np.errstate(over="ignore"):
        x = (sums[size:] - sums[:-size]) * _DOWN[: len(sums) - size]
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def anchors(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Pieces of a text: where the piece starts, the hash and the place in the piece of each anchor,
    the first and the last suffix it owns, and the bytes of the piece."""
    for low in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        part = raw[low : low + PIECE + LENGTH - 1]
        grams = _hashes(_sums(np.frombuffer(part, np.uint8)), GRAM)
        count = len(part) - LENGTH + 1  # suffixes of this piece
        places = np.arange(len(grams), dtype=np.uint64)
        ranked = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
        fill = -len(ranked) % WIDTH
        rows = np.concatenate((ranked, np.full(fill, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, WIDTH)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        owner = np.minimum(behind[:count], ahead[WIDTH - 1 : WIDTH - 1 + count]) & np.uint64((1 << PLACE_BITS) - 1)
        owner = owner.astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], count] - 1
        place = owner[first]
        yield low, grams[place], place, first, last, part


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _repeated_buckets(texts: DataFrame) -> DataFrame:
    """h of the buckets with more than one context, counted over all rows."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [h for t in batch["text"] for _, h, *_ in anchors(_bytes(t))]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else ((), ())
            yield pd.DataFrame({"h": np.asarray(h, np.uint64).view(np.int64), "n": np.asarray(n, np.int64)})

    counted = texts.select("text").mapInPandas(seek, "h bigint, n bigint")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def _spots(texts: DataFrame, table) -> DataFrame:
    """The contexts in the buckets of the table: of which row (rank, key) and place they are, their
    bucket h and class c, and how many suffixes they have beside the first."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = unpacked(table.value)
        for batch in batches:
            rows = [
                (rank, key, *spot[:4])
                for rank, key, text in zip(batch["rank"], batch["key"], batch["text"])
                for spot in _wanted(text, wanted)
            ]
            yield pd.DataFrame(rows, columns=["rank", "key", "at", "h", "c", "more"])

    return texts.mapInPandas(seek, "rank string, key bigint, at bigint, h bigint, c bigint, more int")


def _wanted(text: str | None, table: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """at, h, c, more and the bytes of the contexts of a text in the buckets of the table."""
    for low, h, place, first, last, part in anchors(_bytes(text)):
        for i in np.flatnonzero(table[slots_of(h)]).tolist():
            a, b, p = int(first[i]), int(last[i]), int(place[i])
            context = part[a : b + LENGTH]
            c = xxhash.xxh3_64_intdigest(context, (p - a) << 10 | (p - b))
            yield low + a, int(h[i].view(np.int64)), c - (1 << 64) if c >> 63 else c, b - a, context


def _place_hash(key: int, at: int) -> int:
    """What xxhash64(key, at) gives in Spark, without the sign."""
    inner = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(at.to_bytes(8, "little"), inner)


def _class_bytes(texts: DataFrame, buckets, places) -> DataFrame:
    """key, at and context of those spots that the table of places names: the first of each class,
    and a few others that share a slot with one."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, named = unpacked(buckets.value), unpacked(places.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                for at, h, c, _, context in _wanted(text, wanted):
                    if named[_place_hash(key, at) >> 40 & SLOTS - 1]:
                        rows.append((key, at, h, c, context))
            yield pd.DataFrame(rows, columns=["key", "at", "h", "c", "context"])

    return texts.select("key", "text").mapInPandas(seek, "key bigint, at bigint, h bigint, c bigint, context binary")


def suffix_levels(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(depth, ranks): the rank of the `depth` bytes from each place on among all, for depths of 8, 16,
    32, ... and LENGTH; at the end fewer bytes count. Each depth is ranked by pairs of the one before."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    rank = np.unique(np.ascontiguousarray(words).view(">u8").reshape(-1), return_inverse=True)[1]
    depth, levels = 8, []
    while True:
        levels.append((depth, rank.astype(np.int32)))
        if depth == LENGTH:
            return levels
        step = min(depth, LENGTH - depth)
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:] if step < len(rank) else []
        rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + later + 1, return_inverse=True)[1]
        depth += step


def common_prefixes(levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes from the places a and from the places b on are the same, LENGTH at most. Both
    have LENGTH bytes."""
    size = np.zeros(len(a), np.int64)
    for depth, rank in levels[-2::-1]:  # each power of two below LENGTH, the largest first
        x, y = a + size, b + size
        inside = np.maximum(x, y) + depth <= len(data)
        same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
        size += np.where(same, depth, 0)
    going = np.flatnonzero(size < LENGTH)
    for _ in range(levels[0][0] - 1):
        x, y = a[going] + size[going], b[going] + size[going]
        inside = np.maximum(x, y) < len(data)
        going = going[inside]
        going = going[data[x[inside]] == data[y[inside]]]
        size[going] += 1
    return np.minimum(size, LENGTH)


def nearest_smaller(value: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest smaller value before each (-1: none), and the least of `between`, the
    numbers for each two neighbours, on the way there (0: none).

    All places look back at once; who meets a larger value goes on from where that one looks, for
    nothing smaller lies between.
    """
    to = np.arange(len(value)) - 1
    least = np.concatenate((np.zeros(1, np.int64), between))[: len(value)]
    going = np.flatnonzero((to >= 0) & (value[to] > value))
    while len(going):
        via = to[going]
        low, new = np.minimum(least[going], least[via]), to[via]
        least[going], to[going] = low, new
        going = going[(new >= 0) & (value[new] > value[going])]
    return to, np.where(to < 0, 0, least)


def previous_factors(
    levels: list[tuple[int, np.ndarray]], data: np.ndarray, at: np.ndarray, group: np.ndarray, position: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes that start `at` places of the data: the length of the longest previous factor, LENGTH
    at most, and the index of a suffix it comes from (-1: none). Only suffixes of one group, with a
    smaller position, count as previous. Positions of a group differ."""
    rank = levels[-1][1][at].astype(np.int64)
    order = np.lexsort((position, group.astype(np.int64) * (len(data) + 1) + rank))
    r, g = rank[order], group[order]
    # Of suffixes with LENGTH equal bytes, ordered by position, each has the one before as its previous
    # smaller position. Only the first of them, the heads, look further.
    head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1]))))
    heads = order[head]
    length = np.full(len(order), LENGTH, np.int64)
    source = np.full(len(order), -1, np.int64)
    source[order[1:]] = order[:-1]
    between = common_prefixes(levels, data, at[heads[:-1]], at[heads[1:]])
    between[g[head[1:]] != g[head[:-1]]] = 0
    before, ahead = nearest_smaller(position[heads], between)
    after, behind = nearest_smaller(position[heads][::-1], between[::-1])
    after, behind = len(heads) - 1 - after[::-1], behind[::-1]
    longest = np.maximum(ahead, behind)
    from_head = np.where(ahead >= behind, before, after) % len(heads)
    length[heads] = longest
    source[heads] = np.where(longest > 0, heads[from_head], -1)
    return length, source


def _sorted_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For rows (h, c, context, more, place) that come by bucket: first and last suffix of each
    class that another class of the bucket has (`any`), or an earlier one (`earlier`)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["context"].map(len).to_numpy()
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(rows["context"]), np.uint8)
        levels = suffix_levels(data)
        owned = rows["more"].to_numpy() + 1
        which = np.repeat(np.arange(len(rows)), owned)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(owned) - owned, owned)
        # Positions: classes by their first occurrence, then the place in the context.
        position = rows["place"].to_numpy()[which] * (LENGTH * 2) + offset
        bucket = np.cumsum(np.concatenate(([0], rows["h"].to_numpy()[1:] != rows["h"].to_numpy()[:-1])))[which]
        length, source = previous_factors(levels, data, starts[which] + offset, bucket, position)
        earlier = length >= LENGTH
        met = earlier.copy()
        met[source[earlier]] = True  # what an earlier match gives has a later copy
        out = {"h": rows["h"].to_numpy(), "c": rows["c"].to_numpy()}
        bounds = np.cumsum(owned) - owned
        for name, hit in (("any", met), ("earlier", earlier)):
            low = np.minimum.reduceat(np.where(hit, offset, LENGTH), bounds)
            high = np.maximum.reduceat(np.where(hit, offset, -1), bounds)
            out |= {f"{name}_low": low, f"{name}_high": high}
        return pd.DataFrame(out)

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        # Only whole buckets are solved: the last one may go on in the next batch.
        h = batch["h"].to_numpy()
        cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
        low = 0
        for cut in [*cuts.tolist(), len(h)]:
            group = batch.iloc[low:cut]
            if held and size > TOGETHER and held[-1]["h"].iloc[-1] != group["h"].iloc[0]:
                yield solve(pd.concat(held, ignore_index=True))
                held, size = [], 0
            held.append(group)
            size += int(group["context"].map(len).sum())
            low = cut
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, c, offset, v, w): two hashes of the LENGTH bytes of each suffix of each class."""
    for batch in batches:
        for row in batch.itertuples():
            data = np.frombuffer(row.context, np.uint8)
            first = _hashes(_sums(data), LENGTH)
            second = _hashes(_sums(data[::-1]), LENGTH)[::-1]
            yield pd.DataFrame(
                {
                    "h": row.h,
                    "c": row.c,
                    "offset": np.arange(row.more + 1, dtype=np.int32),
                    "v": first[: row.more + 1].view(np.int64),
                    "w": np.ascontiguousarray(second[: row.more + 1]).view(np.int64),
                }
            )


def _join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """`rows` joined with `counted`, whose n says how many of the `total` rows a key has."""
    heavy = F.col("n") * HEAVY > total
    hot = F.broadcast(counted.filter(heavy))  # fewer than HEAVY rows
    cold = rows.join(F.broadcast(counted.filter(heavy).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(counted.filter(~heavy), on))


def _found_in_classes(mixed: DataFrame, contexts: DataFrame) -> DataFrame:
    """h, c, and the first and last suffix of the class that others of its bucket have, staged. `mixed`
    are the classes that share a bucket with others."""
    first = mixed.select("h", "c", "size", "more", "first", F.col("first.key").alias("key"), F.col("first.at").alias("at"))
    bare = contexts.join(first, ["h", "c", "key", "at"]).dropDuplicates(["h", "c"])
    bare = stage(bare.select("h", "c", "context", "more", "size", "first"))
    schema = "h bigint, c bigint, any_low int, any_high int, earlier_low int, earlier_high int"

    few = bare.filter(F.col("size") <= SORTED)
    place = F.row_number().over(Window.partitionBy("h").orderBy("first")).cast("bigint")
    few = few.select("h", "c", "context", "more", place.alias("place")).mapInPandas(_sorted_buckets, schema)

    many = bare.filter(F.col("size") > SORTED)
    windows = many.select("h", "c", "context", "more").mapInPandas(
        _window_hashes, "h bigint, c bigint, offset int, v bigint, w bigint"
    )
    windows = stage(windows.join(many.select("h", "c", "first"), ["h", "c"]))
    shared = stage(
        windows.groupBy("h", "v", "w")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
        .filter("n > 1")
    )
    met = _join_counted(windows, shared, ["h", "v", "w"], windows.count())
    later = F.when(F.col("first") > F.col("least"), F.col("offset"))
    many = met.groupBy("h", "c").agg(
        F.min("offset").alias("any_low"),
        F.max("offset").alias("any_high"),
        F.coalesce(F.min(later), F.lit(LENGTH)).alias("earlier_low"),
        F.coalesce(F.max(later), F.lit(-1)).alias("earlier_high"),
    )
    found = stage(few.union(many))
    for table in (bare, windows, shared):
        drop_table(table)
    return found


def _rank(docs: DataFrame, id_column: str) -> Column:
    """A text that sorts as the ids do, whole numbers by value; nulls first."""
    own = F.col(f"`{id_column}`")
    if docs.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long"):
        own = F.lpad((own.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return own.cast("string")


def _met(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The contexts of rows (rank, key, text) in buckets of several; of their classes those that have
    anything twice, with what `_found_in_classes` gives; and the number of the contexts."""
    context = rows.sparkSession.sparkContext
    repeated = stage(_repeated_buckets(rows))
    table = context.broadcast(slot_table(repeated, "h"))
    drop_table(repeated)
    spots = stage(_spots(rows, table))
    table.destroy()
    first = F.min(F.struct("rank", "key", "at")).alias("first")
    classes = stage(spots.groupBy("h", "c", "more").agg(F.count(F.lit(1)).alias("n"), first))
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    mixed = stage(classes.join(sizes, "h"))
    buckets = context.broadcast(slot_table(mixed, "h"))
    places = context.broadcast(slot_table(mixed, F.xxhash64("first.key", "first.at")))
    found = _found_in_classes(mixed, _class_bytes(rows, buckets, places))
    for sent in (buckets, places):
        sent.destroy()
    known = stage(
        classes.drop("more").join(found, ["h", "c"], "left").filter((F.col("n") > 1) | (F.col("any_high") >= 0))
    )
    for done in (classes, mixed, found):
        drop_table(done)
    return spots, known, spots.count()


def repeated_spans(rows: DataFrame, keep: str = "first") -> DataFrame:
    """key and `spans`, an array of (start, end) in bytes, for the rows (rank, key, text) that have any.

    A byte is in a span if it lies in LENGTH bytes that also start at another place, of this or
    another row (keep="none"), or at an earlier one by rank, key and place (keep="first").
    """
    with settings(rows.sparkSession, SMALL_BATCHES):
        spots, known, total = _met(rows)
    place = F.struct("rank", "key", "at")
    met = _join_counted(spots, known, ["h", "c"], total)
    copied = F.col("n") > 1
    if keep == "first":  # all but the first of a class lie in an earlier one
        copied &= place > F.col("first")
    by = "earlier" if keep == "first" else "any"
    low = F.when(copied, F.lit(0)).otherwise(F.col(f"{by}_low"))
    high = F.when(copied, F.col("more")).otherwise(F.col(f"{by}_high"))
    spans = (
        met.withColumn("low", low)
        .withColumn("high", high)
        .filter("high >= 0")
        .select("key", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + LENGTH).alias("end"))
        .distinct()
    )
    return spans.groupBy("key").agg(_merged(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    nothing = F.struct(none.alias("out"), F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))

    def closed(s: Column) -> Column:
        return F.when(
            s["start"] >= 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        ).otherwise(s["out"])

    return F.aggregate(
        spans,
        nothing,
        lambda s, x: F.when(
            x["start"] <= s["end"],
            F.struct(s["out"].alias("out"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end")),
        ).otherwise(F.struct(closed(s).alias("out"), x["start"].alias("start"), x["end"].alias("end"))),
        closed,
    )


def remove_repeats(
    docs: DataFrame, keep: str = "first", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`docs` with `spans`, the removed (start, end) in bytes of the UTF-8 text, and `kept`, the
    other bytes; both added or replaced.

    keep="first" removes what has been seen before, in the order of ids and places, so the first
    copy of everything stays; keep="none" removes every copy. Matches have at least LENGTH bytes
    and lie within one text, and what counts are the texts as they come in. A null text is empty.
    Rows of one id and text are the same document to "first" (they stay or go together), and
    copies of each other to "none". A span may begin or end inside a character.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be first or none, not {keep!r}")
    key = row_key(docs, id_column, text_column)
    # Only "first" asks for an order.
    rank = _rank(docs, id_column) if keep == "first" else F.lit(None).cast("string")
    rows = docs.select(rank.alias("rank"), key.alias("key"), F.col(f"`{text_column}`").alias("text"))
    found = repeated_spans(rows, keep)
    own = [c for c in docs.columns if c not in ("spans", "kept")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("key"))
    joined = held.join(found, "key", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    raw = F.coalesce(F.col("row")[text_column], F.lit("")).cast("binary")
    cut = joined.select("row", F.coalesce("spans", none).alias("spans"), raw.alias("raw"))
    empty = F.lit("").cast("binary")
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("kept")),
        lambda s, x: F.struct(
            x["end"].alias("at"),
            F.concat(
                s["kept"],
                F.substring(F.col("raw"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
            ).alias("kept"),
        ),
        lambda s: F.concat(
            s["kept"], F.substring(F.col("raw"), (s["at"] + 1).cast("int"), F.octet_length("raw"))
        ),
    )
    return cut.select("row.*", "spans", pieces.alias("kept"))
