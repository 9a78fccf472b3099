"""Benchmark items in documents: word n-grams as seeds, Smith-Waterman alignment as judge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.staging import stage

#: Words of a seed.
SEED = 3
#: Seeds of a document this many words apart or closer are one cluster, which is aligned with as
#: many words around it; more for longer items, see `_reach`.
REACH = 64
#: Slots of the table that tells a task which seeds to look for: its size does not depend on the
#: benchmark. Seeds of several items may share a slot; the join on whole hashes tells them apart.
SLOTS = 1 << 24
#: Items of up to this many seeds count from one seed on, others need two in a cluster, or one if
#: replaced words can leave so few.
FEW = 4
#: Share of an item's seeds that must be in a cluster before it is aligned, or fewer if replaced
#: words can leave fewer. It does not depend on other documents.
SEED_SHARE = 0.1
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score of the item, as a share of what an exact copy scores.
SIMILARITY = 0.6
#: Cells of the tables that are filled together, and bytes hashed together, to bound memory.
CELLS, BYTES = 1 << 20, 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = BYTES + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, _BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased: a run of ASCII letters and digits and of whatever
    is not ASCII. All other characters separate words."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    out, low = [], 0
    while low < len(raw):
        high = min(len(raw), low + BYTES)
        if high < len(raw):  # end between words if the piece has a place for that
            cut = high
            while cut > low and _IS_WORD[raw[cut - 1]]:
                cut -= 1
            high = cut if cut > low else high
        data = np.frombuffer(raw[low:high], np.uint8)
        inside = _IS_WORD[data]
        edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)))
            out.append(_mixed((sums[ends] - sums[starts]) * _DOWN[starts]))
        low = high
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def seed_hashes(words: np.ndarray, run: int = SEED) -> np.ndarray:
    """The hash of each run of so many words; a text of fewer words has one, of all of them."""
    if not len(words):
        return words
    size = min(run, len(words))
    found = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            found = _mixed(found * np.uint64(_BASE) + words[i : i + len(found)])
    return found


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _benchmark_words(items: DataFrame, item_column: str, text_column: str, similarity: float) -> DataFrame:
    """which (a key), item, words, seeds and `need` of each distinct item that has words.

    `need` is the number of its seeds that must be in a cluster. A replaced or missing word costs
    at least the score of a match and a gap, and up to SEED seeds.
    """

    @F.pandas_udf("array<int>")
    def short_words(text: pd.Series) -> pd.Series:
        return pd.Series([word_hashes(t).astype(np.uint32).view(np.int32) for t in text])

    @F.pandas_udf("array<bigint>")
    def seeds(text: pd.Series) -> pd.Series:
        return pd.Series([seed_hashes(word_hashes(t)).view(np.int64) for t in text])

    text = F.col(f"`{text_column}`")
    cut = items.select(
        F.col(f"`{item_column}`").alias("item"), short_words(text).alias("words"), seeds(text).alias("seeds")
    )
    keyed = cut.filter("size(words) > 0").withColumn("which", F.xxhash64(F.col("item").isNull(), "item", "words"))
    distinct = F.size(F.array_distinct("seeds"))
    lost = F.floor(F.size("words") * (MATCH * (1 - similarity)) / (MATCH - GAP) + 1e-9)
    usual = F.greatest(F.lit(2), F.ceil(SEED_SHARE * distinct))
    need = F.when(F.size("seeds") <= FEW, 1).otherwise(F.greatest(F.lit(1), F.least(usual, distinct - SEED * lost)))
    return stage(keyed.dropDuplicates(["which"]).withColumn("need", need.cast("int")))


def _slot_table(known: DataFrame) -> np.ndarray:
    """For each slot 0, 1 if a seed falls there, 2 if it is one of an item that needs one only."""
    found = (
        known.select(F.explode("seeds").alias("seed"), F.when(F.col("need") == 1, 2).otherwise(1).alias("kind"))
        .groupBy(F.shiftrightunsigned("seed", 40).bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
        .agg(F.max("kind").alias("kind"))
        .select(F.col("slot").cast("int"), F.col("kind").cast("byte"))
        .toPandas()  # at most SLOTS rows of five bytes
    )
    table = np.zeros(SLOTS, np.uint8)
    table[found["slot"].to_numpy()] = found["kind"].to_numpy()
    return table


def _reach(known: DataFrame) -> int:
    """How far apart seeds of one alignment may be: an alignment that scores at all has fewer extra
    words, and fewer words between two seeds, than its item has words and gaps, MATCH for each."""
    longest = known.agg(F.max(F.size("words"))).first()[0] or 0
    return max(REACH, MATCH * longest)


def _clusters(docs: DataFrame, table, reach: int) -> DataFrame:
    """key, first (place of its first word), words and distinct seeds of each cluster of seeds."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = table.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                words = word_hashes(text)
                seeds = seed_hashes(words)
                kind = kinds[_slot(seeds)]
                at = np.flatnonzero(kind)
                if not len(at):
                    continue
                for run in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
                    distinct = np.unique(seeds[run])
                    if len(distinct) < 2 and kind[run].max() < 2:
                        continue
                    low, high = max(0, run[0] - reach), run[-1] + SEED + reach
                    rows.append(
                        (key, int(low), words[low:high].astype(np.uint32).view(np.int32), distinct.view(np.int64))
                    )
            yield pd.DataFrame(rows, columns=["key", "first", "words", "seeds"])

    return docs.mapInPandas(seek, "key bigint, first int, words array<int>, seeds array<bigint>")


def align(words: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of each pair, and the place after the last aligned word.

    All pairs advance together, item word by item word. A row of a table is the best of diagonal
    and upper neighbours; gaps along it follow from a running maximum, since a gap costs the same
    for each word.
    """
    scores, ends = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    order = np.argsort([len(w) for w in words], kind="stable")
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * (len(words[order[high]]) + 1) <= CELLS:
            high += 1
        part = order[low:high]
        width, depth = len(words[part[-1]]), max(len(items[p]) for p in part)
        text = np.zeros((len(part), width), np.int64)
        item = np.full((len(part), depth), 1 << 41, np.int64)
        for row, p in enumerate(part):
            text[row, : len(words[p])] = words[p]
            text[row, len(words[p]) :] = 1 << 40
            item[row, : len(items[p])] = items[p]
        slope = GAP * np.arange(1, width + 1)
        last = np.zeros((len(part), width + 1), np.int64)
        best, end = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for i in range(depth):
            step = np.where(text == item[:, i : i + 1], MATCH, MISMATCH)
            now = np.maximum(last[:, :-1] + step, last[:, 1:] + GAP)
            now = np.maximum(now, 0)
            now = np.maximum(now, np.maximum.accumulate(now - slope, axis=1) + slope)
            last[:, 1:] = now
            top = now.argmax(1)
            value = now[np.arange(len(part)), top]
            better = value > best
            best = np.where(better, value, best)
            end = np.where(better, top + 1, end)
        scores[part], ends[part] = best, end
        low = high
    return scores, ends


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores, ends = align(list(batch["words"]), list(batch["item_words"]))
        sizes = batch["item_words"].map(len).to_numpy()
        yield pd.DataFrame(
            {
                "key": batch["key"],
                "which": batch["which"],
                "similarity": scores / (MATCH * sizes),
                "end": batch["first"].to_numpy() + ends,
            }
        )


def row_key(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """The same number for rows of the same id and text, whatever is null."""
    return F.xxhash64(
        F.col(f"`{id_column}`").isNull(), F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    )


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """key (see `row_key`), item, similarity and `end` (number of the document's word after the aligned part),
    for each document and item with an alignment of at least that similarity.

    Similarity is the Smith-Waterman score of the item in the document over that of an exact copy,
    so it is 1 for copies up to case and punctuation, and falls by about 1.5 times the share of
    words that are changed. Documents are searched whole; a task looks for seeds through a table
    of fixed size, so the benchmark may have any size. A cluster of seeds goes on to alignment
    with an item if a tenth of its seeds are there, or what replaced words must leave of a short
    one; which other documents hold the item does not matter. Items or documents that are
    null or without words match nothing, items of fewer words than a seed only texts of the same
    words. Equal rows count once; extra columns are not looked at.
    """
    known = _benchmark_words(items, item_column, item_text_column, similarity)
    table = docs.sparkSession.sparkContext.broadcast(_slot_table(known))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        row_key(docs, id_column, text_column).alias("key"),
        F.col(f"`{text_column}`").alias("text"),
    )
    clusters = _clusters(rows.select("key", "text"), table, _reach(known))
    clusters = stage(clusters.withColumn("cluster", F.monotonically_increasing_id()))

    quoted = clusters.select("cluster", F.explode("seeds").alias("seed"))
    asked = known.select("which", "need", F.explode(F.array_distinct("seeds")).alias("seed"))
    pairs = (
        quoted.join(asked, "seed")
        .groupBy("cluster", "which")
        .agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        .filter("n >= need")
        .select("cluster", "which")
    )
    texts = known.select("which", F.col("words").alias("item_words"))
    met = pairs.join(clusters.select("cluster", "key", "first", "words"), "cluster").join(texts, "which")
    scored = (
        met.select("key", "first", "words", "which", "item_words")
        .mapInPandas(_aligned, "key bigint, which bigint, similarity double, end int")
        .filter(F.col("similarity") >= similarity)
        .join(known.select("which", "item"), "which")
    )
    best = F.max(F.struct("similarity", "end"))
    return scored.groupBy("key", "item").agg(best.alias("best")).select("key", "item", "best.*")


def contaminated_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Id, item, similarity: `contaminations` with the ids of the documents."""
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    item_column = options.get("item_column", "item_id")
    found = stage(contaminations(docs, items, **options))
    ids = docs.select(
        row_key(docs, id_column, text_column).alias("key"), F.col(f"`{id_column}`").alias(id_column)
    )
    keys = found.select("key").distinct()
    named = ids.join(keys, "key", "left_semi").distinct()
    return named.join(found, "key").select(id_column, F.col("item").alias(item_column), "similarity", "end")


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without those that hold an item; columns as before, repeated rows as before."""
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    keys = stage(contaminations(docs, items, **options).select("key").distinct())
    name = "_key_" + "_".join(c for c in docs.columns if c.startswith("_key_"))
    keyed = docs.withColumn(name, row_key(docs, id_column, text_column))
    return keyed.join(keys, keyed[name] == keys["key"], "left_anti").drop(name)
