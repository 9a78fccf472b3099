"""Phrase collocations mined by dynamic itemset counting.

Rows are dealt to shards, which are scanned in turn, round and round. Words are counted from the
first scan on. A longer phrase becomes active once both phrases of one word less, its first and its
last words, have reached the threshold; that may be in the middle of a round, while they are still
counted. It is counted for one full cycle from the next scan on, wherever that starts, so every
shard counts once. Lengths are thus interleaved. After each cycle but the first the shards are
written anew without the words that no phrase still to be counted needs.

What has reached the threshold, and when, is told to the tasks by a table of SLOTS bytes for each
length. A phrase is judged by the slots of its parts. Phrases that share a slot can make it active
too early or in vain, which costs time and nothing else: it still gets one full cycle from the step
that its slots name, the same in all tasks. Counts are therefore exact, and no scan joins anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.staging import drop_table, stage

#: Slots of the tables sent to the tasks, a byte each. Their size does not depend on the data.
SLOTS = 1 << 24
#: The entry of a slot that no phrase has reached; steps must stay below.
NEVER = 255
#: Characters whose words are counted together, to bound the memory of a task.
CHUNK = 1 << 22
#: Tasks that first rank the phrases of one language by themselves.
SALTS = 32

_CUT = re.compile("[ \n]")
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SCHEMA = "lang string, phrase string, words int, start int, slot int, n bigint"

Tables = dict[int, tuple[np.ndarray, np.ndarray]]


def prepared(text: Column) -> Column:
    """A-Z lower-cased, a line feed where a piece ends, spaces between words; null is empty."""
    upper, ends = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?\n\x0b\x0c\r"
    return F.translate(F.coalesce(text, F.lit("")), upper + ends + "\t", upper.lower() + "\n" * len(ends) + " ")


def blocks(texts: Iterator[str], longest: int) -> Iterator[tuple[str, str]]:
    """Prepared texts in blocks of about CHUNK characters, and for a block that ends within a text
    the `longest - 1` words of the same piece that follow it."""
    ahead = re.compile(r"(?: +[^ \n]+){0,%d}" % (longest - 1))
    waiting, size = [], 0
    for text in texts:
        low = 0
        while len(text) - low > CHUNK:
            found = _CUT.search(text, low + CHUNK)
            if not found:
                break
            yield text[low : found.start()], ahead.match(text, found.start()).group()
            low = found.start()
        waiting.append(text[low:])
        size += len(text) - low
        if size >= CHUNK:
            yield "\n".join(waiting), ""
            waiting, size = [], 0
    if waiting:
        yield "\n".join(waiting), ""


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(29))) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


@dataclass(frozen=True)
class Block:
    """Words and line feeds as codes, and what they stand for; the first `inside` are the block's own."""

    codes: np.ndarray
    inside: int
    words: np.ndarray
    hash_of: np.ndarray
    end: int

    @classmethod
    def of(cls, lang: str, block: str, ahead: str) -> Block:
        tokens = block.replace("\n", " \n ").split(" ")
        codes, words = pd.factorize(np.array(tokens + ahead.split(" "), dtype=object))
        blank, end = (next(iter(np.flatnonzero(words == mark)), -1) for mark in ("", "\n"))
        inside = int(np.count_nonzero(codes[: len(tokens)] != blank))
        codes = codes[codes != blank]
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        hashed = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words)
        return cls(codes, inside, words, np.fromiter(hashed, np.uint64, len(words)), end)


def known_parts(
    block: Block, longest: int, tables: dict[int, np.ndarray], slots: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For lengths k from 2 on: k, the step in which the last part of the k words from each place
    got known (NEVER if one is not; an end never is), and the hash of their first k - 1 words where
    all parts are known. The arrays are reused."""
    first = block.hash_of[block.codes]
    reach = h = None
    for k in range(2, longest + 1):
        if k - 1 not in tables:
            return
        if reach is None:
            reach, h = tables[1][_slots(block.hash_of, slots)][block.codes], first.copy()
            reach[block.codes == block.end] = NEVER
        else:
            at = np.flatnonzero(reach < NEVER)
            h[at] = _extended(h[at], first[at + k - 2])
            reach[at] = np.maximum(reach[at], tables[k - 1][_slots(h[at], slots)])
        reach = np.maximum(reach[:-1], reach[1:])
        yield k, reach, h


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h * _P + word


def count_block(
    lang: str, block: Block, step: int, shards: int, longest: int, tables: dict[int, np.ndarray], slots: int
) -> Iterator[pd.DataFrame]:
    """The active phrases that start in a block, with the step each has been active since."""
    codes, inside, words = block.codes, block.inside, block.words
    if step < shards:
        counts = np.bincount(codes[:inside], minlength=len(words))
        counts[(words == "\n") | (words == "")] = 0
        used = np.flatnonzero(counts)
        if len(used):
            yield _frame(lang, [""], 0, 0, np.zeros(1, np.int64), counts[used].sum()[None])
            yield _frame(lang, words[used], 1, 0, _slots(block.hash_of[used], slots), counts[used])
    for k, reach, h in known_parts(block, longest, tables, slots):
        since = reach[:inside].astype(np.int64) + 1
        places = np.flatnonzero((since <= step) & (since + shards > step))
        if len(places):
            own = _extended(h[places], block.hash_of[codes[places + k - 1]])
            yield from _phrases(lang, words, codes, places, k, own, since, slots)


def trim_block(
    block: Block, follows: bool, k: int, step: int, shards: int, tables: dict[int, np.ndarray], slots: int
) -> str:
    """The words of a block inside `k` words that are frequent or may become so, cut elsewhere.

    `follows` tells that the block goes on with the piece of the one before; its first words stay."""
    n = len(block.codes)
    live = np.zeros(n + 1, np.int64)
    for length, reach, h in known_parts(block, k, tables, slots):
        if length < k:
            continue
        at = np.flatnonzero(reach < NEVER)
        good = reach[at].astype(np.int64) + 1 + shards > step
        if k in tables:
            good |= tables[k][_slots(_extended(h[at], block.hash_of[block.codes[at + k - 1]]), slots)] < NEVER
        live[at[good]] = 1
    before = np.r_[0, np.cumsum(live[:n])]
    here = np.arange(block.inside)
    kept = before[here + 1] > before[np.maximum(here - k + 1, 0)]
    tied = before[here + 1] > before[np.maximum(here - k + 2, 0)]
    if follows:
        kept[: k - 1] = tied[: k - 1] = True
    is_end = np.r_[block.codes, block.end][: block.inside + 1] == block.end
    kept &= ~is_end[:-1]
    tied &= ~is_end[1:]
    tied[:-1] &= kept[1:]
    return "".join((block.words[block.codes[: block.inside]] + np.where(tied, " ", "\n").astype(object))[kept])


def _phrases(lang, words, codes, places, k, hashes, since, slots) -> Iterator[pd.DataFrame]:
    _, index, group, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    chosen = places[index]
    same = np.ones(len(places), bool)
    for j in range(k):
        same &= codes[places + j] == codes[chosen[group] + j]
    if not same.all():  # equal hashes of different phrases
        rows, group, n = np.unique(codes[places[:, None] + np.arange(k)], axis=0, return_inverse=True, return_counts=True)
        chosen = np.empty(len(rows), np.int64)
        chosen[group.reshape(-1)] = places
        hashes_of = np.empty(len(rows), np.uint64)
        hashes_of[group.reshape(-1)] = hashes
    else:
        hashes_of = hashes[index]
    phrase = words[codes[chosen]]
    for j in range(1, k):
        phrase = phrase + " " + words[codes[chosen + j]]
    yield _frame(lang, phrase, k, since[chosen], _slots(hashes_of, slots), n)


def _frame(lang, phrase, words, start, slot, n) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "phrase": phrase, "words": words, "start": start, "slot": slot, "n": n})


def _scan(shard: DataFrame, step: int, shards: int, longest: int, sparse: Tables, slots: int) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _dense(sparse, slots)
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                for text, ahead in blocks(iter(texts), longest):
                    block = Block.of(lang, text, ahead)
                    yield from count_block(lang, block, step, shards, longest, tables, slots)

    return shard.select("lang", "text").mapInPandas(count, _SCHEMA)


def _dense(sparse: Tables, slots: int) -> dict[int, np.ndarray]:
    tables = {}
    for k, (at, steps) in sparse.items():
        tables[k] = np.full(slots, NEVER, np.uint8)
        tables[k][at] = steps
    return tables


def _trimmed(dealt: DataFrame, step: int, shards: int, longest: int, sparse: Tables, slots: int) -> DataFrame:
    """The shards without the words that no phrase needs any more: phrases of step / shards words and
    fewer are counted, so what matters is inside phrases of one word more. A row is a block."""
    k = step // shards + 1

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _dense(sparse, slots)
        for batch in batches:
            for (lang, shard), texts in batch.groupby(["lang", "shard"], sort=False)["text"]:
                parts, follows, out = [], False, []
                for text, ahead in blocks(iter(texts), longest):
                    parts.append(trim_block(Block.of(lang, text, ahead), follows, k, step, shards, tables, slots))
                    follows = bool(ahead)
                    if not follows:
                        out.append("".join(parts))
                        parts = []
                out = [t for t in [*out, "".join(parts)] if t]
                if out:
                    yield pd.DataFrame({"lang": lang, "text": out, "shard": shard})

    return dealt.mapInPandas(trim, dealt.schema)


def _reached(live: DataFrame, step: int, longest: int) -> dict[int, np.ndarray]:
    """By length, the slots of what has reached the threshold in this step; SLOTS / 64 rows each at most."""
    new = live.filter((F.col("reach") == step) & F.col("words").between(1, longest - 1))
    bit = F.expr("shiftleft(1L, slot & 63)")
    rows = new.groupBy("words", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    found = {}
    for k, part in rows.groupby("words"):
        bits = np.unpackbits(part["bits"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        found[int(k)] = part["at"].to_numpy()[row].astype(np.int64) * 64 + place
    return found


def frequent_phrases(rows: DataFrame, threshold: int, longest: int = 5, shards: int = 2, slots: int = SLOTS) -> DataFrame:
    """A staged table with lang, phrase, words, n for all phrases of up to `longest` words found `threshold` times or
    more in `rows` (lang, text as `prepared`), and with the phrase '' the number of all words.

    After each step the counts so far are written; two of these tables are kept at a time."""
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    dealt = stage(rows.withColumn("shard", shard), partition_by="shard")
    tables: Tables = {}
    live, step = None, 0
    while step < shards or any((steps >= step - shards).any() for _, steps in tables.values()):
        if step >= NEVER:
            raise ValueError(f"{shards} shards and {longest} words need more than {NEVER} steps")
        if step % shards == 0 and step >= 2 * shards:  # not after the first round, which leaves most
            whole, dealt = dealt, stage(_trimmed(dealt, step, shards, longest, tables, slots), partition_by="shard")
            drop_table(whole)
        counted = _scan(dealt.filter(F.col("shard") == step % shards), step, shards, longest, tables, slots)
        counted = counted.withColumn("reach", F.lit(None).cast("int"))
        so_far = counted if live is None else live.unionByName(counted)
        summed = so_far.groupBy("lang", "phrase").agg(
            *[F.min(c).alias(c) for c in ("words", "start", "slot", "reach")], F.sum("n").alias("n")
        )
        enough = (F.col("n") >= threshold) & (F.col("words") > 0)
        summed = summed.withColumn("reach", F.coalesce("reach", F.when(enough, F.lit(step))))
        before, live = live, stage(summed.filter(enough | (F.col("words") == 0) | (F.col("start") + shards > step + 1)))
        if before is not None:
            drop_table(before)
        for k, at in _reached(live, step, longest).items():
            old, steps = tables.get(k, (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
            new = np.setdiff1d(at, old)
            tables[k] = np.r_[old, new], np.r_[steps, np.full(len(new), step, np.uint8)]
        step += 1
    drop_table(dealt)
    return live


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(found: DataFrame, factor: int) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two and more words, by their weakest cut."""
    counts = found.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    total = found.filter("words = 0").select("lang", F.col("n").alias("n"))
    w = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"), _joined(w, F.lit(1), k).alias("head"), _joined(w, k + 1, F.col("words") - k).alias("tail")
        ),
    )
    phrases = found.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("cut"))
    heads = counts.withColumnsRenamed({"part": "head", "f": "l"})
    tails = counts.withColumnsRenamed({"part": "tail", "f": "r"})
    each = (
        phrases.select("lang", "phrase", "words", "a", "cut.*").join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    )
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    upper = (wide["a"] * wide["n"] * F.lit(factor).cast("decimal(10,0)")).cast("decimal(38,0)")
    # A language may hold most of the phrases: its total is handed to SALTS tasks.
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(total, ["lang", "salt"])
    each = each.withColumns({"upper": upper, "lower": wide["l"] * wide["r"]})
    each = each.withColumn("score", F.expr("upper div lower"))
    weakest = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    best = each.groupBy("lang", "phrase", "words", "a").agg(weakest)
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def without_parts(phrases: DataFrame, percent: int) -> DataFrame:
    """`phrases` but those inside a longer one that has `percent` of their count or more."""
    w = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: _joined(w, start, size)
            ),
        )
    )
    longer = phrases.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = phrases.join(covered, ["lang", "phrase"], "left")
    inside = F.coalesce(F.col("most"), F.lit(0)).cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * percent
    return joined.filter(~inside).drop("most")


def collocations(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    threshold: int = 100,
    longest: int = 5,
    percent: int = 100,
    first: int = 2000,
    factor: int = 1000,
    shards: int = 2,
) -> DataFrame:
    """The `first` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends and those into words at
    spaces and tabs. Phrases of 2 to `longest` words found `threshold` times or more are scored by
    their weakest cut, floor(factor * a * n / (l * r)); ties go to the earlier cut. Phrases inside
    a longer one with `percent` of their count are left out. Ranks go by score and a, descending,
    then by the phrase's bytes. A null language is `und`, a null or empty text has no words,
    repeated rows count each, an empty table gives no rows, other columns are left out.
    """
    if longest < 2 or threshold < 1 or shards < 1:
        raise ValueError("phrases have two words or more; the threshold and the number of shards are positive")
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"),
        prepared(F.col(f"`{text_column}`")).alias("text"),
    )
    found = frequent_phrases(rows, threshold, longest, shards)
    phrases = stage(scored(found, factor))
    drop_table(found)
    kept = without_parts(phrases, percent).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    best = best.filter(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
