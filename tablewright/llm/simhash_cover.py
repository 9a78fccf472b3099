"""SimHash near-duplicates found by covering locality-sensitive hashing.

A pair of fingerprints that differ in at most `radius` bits shares a bucket in at least one table:
each bit gets a nonzero vector of radius + 1 bits, and the table of a nonzero vector v keeps the
bits whose vector has an odd product with v. For any `radius` differing bits there is a v with an
even product with all of them, for they are fewer equations than unknowns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.staging import SMALL_BATCHES, drop_table, settings, stage
from tablewright.llm.decontaminate import row_key, seed_hashes, word_hashes
from tablewright.llm.graph import components
from tablewright.llm.slots import SLOTS, held, slot_table, slots_of

BITS = 64
#: Shingles hashed at a time, to bound memory for very long texts.
CHUNK = 1 << 18


def shingle_slices(text: str | None, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, as UTF-8 with A-Z lower-cased, and where each shingle
    starts and ends. Words end at ASCII white space. A text of fewer words has one shingle, all of
    it; one without words has none."""
    # surrogatepass: never fails, whatever a source has let through.
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(joined)]))
    if len(starts) <= words:
        return joined, starts[:1], ends[-1:]
    return joined, starts[: len(starts) - words + 1], ends[words - 1 :]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    joined, starts, ends = shingle_slices(text, words)
    if not len(starts):
        return 0
    votes = np.zeros(BITS, np.int64)
    for low in range(0, len(starts), CHUNK):
        cut = zip(starts[low : low + CHUNK].tolist(), ends[low : low + CHUNK].tolist())
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in cut), dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint of each text as a bigint of the same 64 bits."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words, seed) for t in batch), np.uint64, len(batch))
            yield pd.Series(found.view(np.int64))

    return of(text)


def as_hex(fingerprint_column: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers."""
    tables = (1 << (radius + 1)) - 1
    vectors = [1 + i % tables for i in range(BITS)]
    masks = []
    for v in range(1, tables + 1):
        kept = sum(1 << i for i, phi in enumerate(vectors) if (phi & v).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _flip(bit: int) -> int:
    return 1 << bit if bit < BITS - 1 else -(1 << (BITS - 1))


def links(found: DataFrame) -> DataFrame:
    """Links (fp, least) that join distinct fingerprints of at most two differing bits.

    `found` has distinct values `fp`. Fingerprints alone in their bucket of every table go first.
    The rest meet at the values one flipped bit away, flipped among the bits that the table drops:
    two that share a bucket are within two bits if and only if they share such a meeting point or
    one is the other's. At most 65 fingerprints can meet at a point, so no group grows with the
    data, no pairs are listed, and none is left out: all that meet are linked to the least.
    """
    masks = covering_masks(2)
    dropped = [[b for b in range(BITS) if not m >> b & 1] for m in masks]
    table = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                for i, m in enumerate(masks)
            ]
        )
    )
    covered = found.select("fp", table.alias("t")).select("fp", "t.i", "t.key")
    crowded = covered.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    flips = F.array(*[F.array(F.lit(0), *[F.lit(_flip(b)) for b in bits]).cast("array<bigint>") for bits in dropped])
    close = (
        covered.join(crowded, ["i", "key"])
        .withColumn("flip", F.explode(flips[F.col("i")]))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    met = close.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter("size(fps) > 1")
    return met.select(F.col("fps")[0].alias("least"), F.explode("fps").alias("fp")).filter("fp <> least").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Id, `fingerprint` (hex) and `component_id`, the least id of all documents that links reach.

    One row per row of `docs`. Documents link if their fingerprints differ in at most two bits; a
    text without words, or null, has fingerprint zero and links like any other. Copies share a
    fingerprint and are one node. Rows of equal or null id are separate rows; a null id is never
    the least one, and a component of null ids only has a null component_id.
    """
    each = stage(
        docs.select(
            F.col(f"`{id_column}`").alias("id"),
            fingerprints(F.col(f"`{text_column}`"), words, seed).alias("fp"),
        )
    )
    found = stage(each.groupBy("fp").agg(F.min("id").alias("least_id")))
    reached = components(links(found.select("fp")))
    nodes = found.join(reached, found["fp"] == reached["node"], "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    roots = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    nodes = nodes.join(roots, "component").select("fp", "component_id")
    return each.join(nodes, "fp").select(
        F.col("id").alias(id_column), as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity: more and wider fingerprints, then the texts themselves.

#: Fingerprints of a text's distinct words. With scattered edits, texts that share four fifths of
#: their five-word shingles differ in about five of 64 bits in each, and ten chances at three bits
#: link nearly all; cut or extended copies differ in more. What they miss, first shingles find.
VOTES, RADIUS = 10, 3
SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a text's parities, see `parities`.
PARITIES = 16
#: About so many texts tell which shingles are common, which are those in at least COMMON of them.
SAMPLED, COMMON = 20_000, 4


def word_fingerprints(words: np.ndarray) -> np.ndarray:
    """VOTES fingerprints of the distinct words, each from other bits of a mix of their hashes."""
    words = np.unique(words)
    if not len(words):
        return np.zeros(VOTES, np.int64)
    out = np.empty(VOTES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(VOTES):
            mixed = (words ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            bits = np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, BITS)
            out[i] = np.packbits(bits.sum(0) * 2 > len(words), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingles, as hashes of 32 bits."""
    return np.unique(seed_hashes(words, SHINGLE).astype(np.uint32)).view(np.int32)


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits: whether the number of distinct shingles that hash to a bit is odd.

    A shingle that only one of two sets has turns one bit, so the bits in which the sets' parities
    differ are at most as many as the shingles that only one of them has.
    """
    count = 64 * PARITIES
    odd = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (count - 1), minlength=count) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_be_alike(x: str, y: str) -> Column:
    """Whether texts x and y (each with n and parities) can have a similarity of SIMILARITY: sets of
    n and m shingles have when at most (n + m)(1 - s) / (1 + s) are in one of them only."""
    turned = " + ".join(f"bit_count({x}.parities.p{i} ^ {y}.parities.p{i})" for i in range(PARITIES))
    sized = f"least({x}.n, {y}.n) + 1e-6 >= {SIMILARITY} * greatest({x}.n, {y}.n)"
    return F.expr(f"{sized} and ({turned}) * {1 + SIMILARITY} <= ({x}.n + {y}.n) * {1 - SIMILARITY} + 1e-6")


def _sketched(rows: DataFrame) -> DataFrame:
    """key, content (a hash of the words in order), fps, and n (number of distinct shingles) and
    parities of rows (key, text)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [word_hashes(t) for t in batch["text"]]
            shingles = [np.unique(seed_hashes(w, SHINGLE)) for w in words]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "content": [xxhash.xxh3_128_hexdigest(w.tobytes()) for w in words],
                    "fps": [word_fingerprints(w) for w in words],
                    "n": [len(found) for found in shingles],
                    "bits": [parities(found) for found in shingles],
                }
            )

    sketched = rows.mapInPandas(sketch, "key bigint, content string, fps array<bigint>, n int, bits array<bigint>")
    fields = F.struct(*[F.col("bits")[i].alias(f"p{i}") for i in range(PARITIES)])
    return sketched.select("key", "content", "fps", "n", fields.alias("parities"))


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """For rows of VOTES fingerprints a 64-bit number of each bucket of each covering table."""
    masks = np.array(covering_masks(RADIUS), np.int64).view(np.uint64)
    kept = fps.view(np.uint64)[:, :, None] & masks[None, None, :]
    tables = np.arange(1, VOTES * len(masks) + 1, dtype=np.uint64).reshape(1, VOTES, -1)
    with np.errstate(over="ignore"):
        mixed = (kept ^ (tables * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(29))).reshape(len(fps), -1)


def _candidates(texts: DataFrame) -> DataFrame:
    """Pairs a < b of rows (key, fps, n, parities) that share a bucket: at most one for each text.

    Buckets are first counted by number alone; only texts in crowded ones go on. In each bucket
    every text meets the leader, the first by a hash of the key, and of the leaders that it may be
    like it is linked to the first. Near copies share the buckets of many tables, so most of a group
    meet the same few leaders, and there are never more pairs than texts, however large a group is.
    No bucket is gathered anywhere. What is not linked that way is left to the shingles.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                fps = np.stack(batch["fps"].iloc[low : low + 1000].to_list())
                yield pd.DataFrame({"bucket": bucket_keys(fps).reshape(-1).view(np.int64)})

    buckets = texts.select("fps").mapInPandas(count, "bucket bigint").groupBy("bucket").count()
    crowded = stage(buckets.filter("count > 1").select("bucket"))
    table = texts.sparkSession.sparkContext.broadcast(slot_table(crowded, "bucket"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low : low + 1000]
                keys = bucket_keys(np.stack(part["fps"].to_list()))
                row, place = np.nonzero(held(table.value, keys))
                yield pd.DataFrame({"bucket": keys[row, place].view(np.int64), "key": part["key"].to_numpy()[row]})

    dealt = stage(texts.select("key", "fps").mapInPandas(deal, "bucket bigint, key bigint"))
    table.destroy()
    pairs = stage(_led(dealt, "bucket", texts))
    for done in (crowded, dealt):
        drop_table(done)
    return pairs


def _led(dealt: DataFrame, place: str, texts: DataFrame) -> DataFrame:
    """Pairs a < b: each key of `dealt` with one leader of the places that it is in.

    The leader of a place is its first key by a hash. Of those that a text may be like, by the
    numbers of shingles and the parities of `texts`, it takes the first.
    """
    order = F.struct(F.xxhash64("key").alias("order"), F.col("key").alias("leader"))
    leads = dealt.groupBy(place).agg(F.min(order).alias("lead"))
    return _first_alike(dealt.join(leads, place).select("key", "lead").filter("key <> lead.leader"), texts)


def _first_alike(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a < b: each key of `met` with the first of its leads that it may be like."""
    met = met.distinct()
    x, y = texts.select("key", "n", "parities").alias("x"), texts.select("key", "n", "parities").alias("y")
    close = met.alias("m").join(x, F.expr("m.key = x.key")).join(y, F.expr("m.lead.leader = y.key"))
    close = close.filter(_may_be_alike("x", "y")).groupBy("m.key").agg(F.min("m.lead")["leader"].alias("leader"))
    return close.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingles have a Jaccard similarity of SIMILARITY or more, staged."""
    pairs = stage(pairs)
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    table = rows.sparkSession.sparkContext.broadcast(slot_table(wanted, "key"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch[held(table.value, batch["key"].to_numpy().view(np.uint64))]
            if len(some):
                sets_ = [_shingles(word_hashes(t)) for t in some["text"]]
                yield pd.DataFrame({"key": some["key"], "shingles": sets_})

    sets = rows.mapInPandas(cut, "key bigint, shingles array<int>").dropDuplicates(["key"])
    sets = stage(sets.join(wanted, "key", "left_semi"))
    table.destroy()
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    alike = shared / (F.size("x") + F.size("y") - shared)
    both_empty = (F.size("x") == 0) & (F.size("y") == 0)
    found = stage(pairs.join(a, "a").join(b, "b").filter(both_empty | (alike >= SIMILARITY)).select("a", "b"))
    for done in (pairs, wanted, sets):
        drop_table(done)
    return found


def rare_first(words: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """The first distinct shingles by (rank of the slot, hash), and how many there are in all.

    Texts with a similarity of SIMILARITY or more share that part of the larger one's shingles, so
    they have one in common among as many of the first as may be missing, and one.
    """
    found = np.unique(seed_hashes(words, SHINGLE))
    spare = len(found) - int(np.ceil(SIMILARITY * len(found) - 1e-9))
    return found[np.lexsort((found, ranks[slots_of(found)]))][: spare + 1], len(found)


def _common(shingles: DataFrame) -> np.ndarray:
    """For each slot how common its shingles are: 0, or the length in bits of their number among
    `shingles`, those of a sample. It sets the order only, and pairs are whole by any order."""
    slot = F.shiftrightunsigned("shingle", 40).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    counted = shingles.groupBy("shingle").count().filter(f"count >= {COMMON}")
    found = counted.groupBy(slot).agg(F.max("count").alias("n")).toArrow()  # at most SLOTS rows
    ranks = np.zeros(SLOTS, np.uint8)
    ranks[found["slot"].to_numpy()] = np.ceil(np.log2(found["n"].to_numpy().astype(np.float64) + 1)).astype(np.uint8)
    return ranks


def _first_shingles(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """shingle, key and place of those first shingles of each text that another text has, too.

    Alike texts share one of their first shingles by an order of all shingles. Common ones come
    last in it, so that a passage that many texts have counts only where a fifth of the text
    is nothing else.
    """
    context = rows.sparkSession.sparkContext
    own = context.broadcast(slot_table(texts, "key"))

    def cut(emit, schema: str, source: DataFrame = rows) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                mine = batch[held(own.value, batch["key"].to_numpy().view(np.uint64))]
                for low in range(0, len(mine), 500):
                    part = mine.iloc[low : low + 500]
                    yield emit(part["key"].to_numpy(), [word_hashes(t) for t in part["text"]])

        return source.mapInPandas(run, schema)

    def every(keys: np.ndarray, words: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"shingle": np.concatenate([np.unique(seed_hashes(w, SHINGLE)) for w in words]).view(np.int64)})

    some = rows.filter(F.expr(f"pmod(key, {max(1, texts.count() // SAMPLED)}) = 0"))
    ranks = context.broadcast(_common(cut(every, "shingle bigint", some)))

    def first(keys: np.ndarray, words: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"shingle": np.concatenate([rare_first(w, ranks.value)[0] for w in words]).view(np.int64)})

    crowded = stage(cut(first, "shingle bigint").groupBy("shingle").count().filter("count > 1").select("shingle"))
    table = context.broadcast(slot_table(crowded, "shingle"))

    def deal(keys: np.ndarray, words: list[np.ndarray]) -> pd.DataFrame:
        found = [rare_first(w, ranks.value)[0] for w in words]
        sizes = [len(f) for f in found]
        shingles = np.concatenate(found)
        met = held(table.value, shingles)
        return pd.DataFrame(
            {
                "shingle": shingles.view(np.int64),
                "key": np.repeat(keys, sizes),
                "place": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]),
            }
        )[met]

    dealt = cut(deal, "shingle bigint, key bigint, place int").join(crowded, "shingle", "left_semi")
    dealt = stage(dealt.join(texts, "key", "left_semi").dropDuplicates(["shingle", "key"]))
    for sent in (own, ranks, table):
        sent.destroy()
    drop_table(crowded)
    return dealt


def _between(dealt: DataFrame, texts: DataFrame, linked: DataFrame) -> DataFrame:
    """`dealt`, the texts' first shingles, where texts of several components of `linked` have one:
    with the `group` of the text, the largest (`most`) of the shingle, n and parities."""
    group = F.coalesce("component", "key").alias("group")
    dealt = dealt.join(linked, dealt["key"] == linked["node"], "left").select("shingle", "key", "place", group)
    dealt = stage(dealt)
    most = F.max(F.struct("count", "group"))["group"].alias("most")
    groups = dealt.groupBy("shingle", "group").count().groupBy("shingle")
    several = groups.agg(F.count(F.lit(1)).alias("groups"), most).filter("groups > 1").select("shingle", "most")
    met = stage(dealt.join(several, "shingle").join(texts.select("key", "n", "parities"), "key"))
    drop_table(dealt)
    return met


def _bridges(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a < b of different groups of `met`: at most one for each text, however large the groups are.

    A shingle's first text, by a hash of the key, meets all of other groups, and the first of the
    other groups those of its own. Of these a text takes the first it may be like.
    """
    order = F.struct(F.xxhash64("key").alias("order"), F.col("key").alias("leader"), "group")
    led = met.select("shingle", "key", "group").join(met.groupBy("shingle").agg(F.min(order).alias("lead")), "shingle")
    away = led.filter("group <> lead.group").groupBy("shingle").agg(F.min(order).alias("other"))
    lead = F.when(F.col("group") == F.col("lead.group"), F.col("other")).otherwise(F.col("lead"))
    return _first_alike(led.join(away, "shingle").select("key", lead.alias("lead")), texts)


def _across(met: DataFrame) -> DataFrame:
    """All pairs (key, other) of texts that may be alike and are not of one group, as often as they
    have a first shingle in common.

    `met` is what `_between` gives; alike texts share one of their first shingles. No pair within
    the largest group of a shingle is looked at. Pairs must fit by their numbers of shingles, the
    places of the shared one and their parities, which is all necessary for a similarity of
    SIMILARITY, so none is left out. Texts that share much, but not enough, meet there and are told
    apart within the join.
    """
    x, y = met.filter("group <> most").alias("x"), met.alias("y")
    once = "x.shingle = y.shingle and x.group <> y.group and (y.group = y.most or x.key < y.key)"
    placed = f"least(x.n - x.place, y.n - y.place) * {1 + SIMILARITY} + 1e-6 >= {SIMILARITY} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"{once} and {placed}") & _may_be_alike("x", "y"))
    return pairs.select(F.col("x.key").alias("key"), F.col("y.key").alias("other"))


def _partners(met: DataFrame) -> DataFrame:
    """Pairs a < b of `_across`: for each text the first by a hash, so that a group takes the same few."""
    first = F.min(F.struct(F.xxhash64("other").alias("order"), "other"))["other"].alias("other")
    return _ordered(_across(met).groupBy("key").agg(first))


def _missed(met: DataFrame) -> DataFrame:
    """All pairs a < b of `_across`."""
    return _ordered(_across(met))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _kept(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The key of the row that stays of each group; `rows` are (key, text) and `ids` (key, rank)."""
    sketched = stage(_sketched(rows))
    ranked = sketched.select("key", "content").join(ids, "key").distinct()
    first = F.min(F.struct("rank", "key")).alias("first")
    contents = stage(ranked.groupBy("content").agg(first))
    leads = contents.select(F.col("first.key").alias("key"), "first")
    texts = sketched.join(leads, "key", "left_semi").select("key", "fps", "n", "parities").dropDuplicates(["key"])
    texts = stage(texts)
    drop_table(sketched)
    shingles = _first_shingles(rows, texts.select("key"))
    close = _verified(rows, _candidates(texts).union(_led(shingles, "shingle", texts)).distinct())
    met = _between(shingles, texts, components(close))
    for propose in (_bridges, lambda met, _: _partners(met)):
        more = _verified(rows, propose(met, texts))
        if not more.isEmpty():
            close = close.union(more)
            drop_table(met)
            met = _between(shingles, texts, components(close))
    more = _verified(rows, _missed(met))
    for done in (met, shingles, texts):
        drop_table(done)
    linked = components(close.union(more))
    groups = leads.join(linked, leads["key"] == linked["node"], "left").select(
        "first", F.coalesce("component", "key").alias("component")
    )
    kept = stage(groups.groupBy("component").agg(F.min("first").alias("first")).select("first.key"))
    drop_table(contents)
    return kept


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of near copies; columns as before.

    Texts are the same if their words are: letters and digits, lower-cased. Others are near copies
    if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints of their words propose first pairs, by covering tables, at most one a text; the
    first of those with a shingle in common propose as many, and as many again between what is
    linked so far. A prefix filter over the shingles then proposes one for each text, and last all
    pairs between what these link, so none is left out. Groups are what links reach.
    Of a group the row of the least id stays, nulls last, and among equal ids one of its texts; of
    repeated rows one stays. Texts without words, and null, are one group.
    """
    key = row_key(docs, id_column, text_column)
    own = F.col(f"`{id_column}`")
    rows = docs.select(key.alias("key"), F.col(f"`{text_column}`").alias("text"))
    ids = docs.select(key.alias("key"), F.struct(own.isNull().alias("absent"), own.alias("id")).alias("rank"))
    with settings(docs.sparkSession, SMALL_BATCHES):
        kept = _kept(rows, ids)
    name = "_key_" + "_".join(c for c in docs.columns if c.startswith("_key_"))
    keyed = docs.withColumn(name, key)
    return keyed.join(kept, keyed[name] == kept["key"], "left_semi").dropDuplicates([name]).drop(name)
