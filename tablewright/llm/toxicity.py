"""Toxicity by two language models: how much likelier words are in toxic than in ordinary text.

Words are runs of letters and digits, lower-cased. Each class has an interpolated Kneser-Ney model
of the next symbol of a word given the four before it: discounted counts of the class at full
context, and below that continuation counts (after how many different symbols a sequence was seen)
that both classes share. So an inflected or rare expression is judged by the stem that the class
has seen, and what neither class has seen costs both the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
#: Symbols: 0 stands before a word, 1 to 26 for letters, 27 for digits. Letters beyond a-z share
#: the 26 by code point, so the tables have a fixed size: SYMBOLS ** ORDER numbers of 16 bits.
SYMBOLS = 28
DISCOUNT = 0.75
#: Characters that are looked at together, to bound memory for long texts.
CHARACTERS = 1 << 20
#: Labelled documents that fit the few numbers of the calibration, about and at most by
#: expectation, chosen by a hash of the text. All labelled documents count in the language models.
CALIBRATED = 20_000
#: Label tables of up to this many rows are sent to every executor.
BROADCAST_ROWS = 1_000_000
FEATURES = 4


def _symbol_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.int32)
    for code in range(1 << 16):
        letter = chr(code)
        if "a" <= letter <= "z":
            table[code] = code - 96
        elif letter.isdigit():
            table[code] = 27
        elif letter.isalpha():
            table[code] = 1 + code % 26
    return table


SYMBOL_OF = _symbol_table()


def symbols(text: str) -> Iterator[np.ndarray]:
    """Symbols of the text, 0 between words, in pieces that end between words where they can."""
    low, text = 0, text.lower()
    while low < len(text):
        high = min(len(text), low + CHARACTERS)
        while low < high < len(text) and text[high - 1].isalnum() and high - low > CHARACTERS // 2:
            high -= 1
        codes = np.frombuffer(text[low:high].encode("utf-32-le", "surrogatepass"), np.uint32)
        yield np.where(codes < 1 << 16, SYMBOL_OF[np.minimum(codes, 0xFFFF)], 1 + codes % 26)
        low = high


def grams(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the ORDER-gram that ends at each letter, and where the words begin among them.
    What stands before the word counts as 0."""
    inside = piece != 0
    number = piece.astype(np.int64)
    open_, scale = inside.copy(), SYMBOLS
    for back in range(1, ORDER):
        open_[back:] &= inside[:-back]
        open_[:back] = False
        number[back:] += np.where(open_[back:], piece[:-back], 0) * scale
        scale *= SYMBOLS
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    return number[inside], np.flatnonzero(first[inside])


def log_ratios(gram: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(symbol | context) in toxic minus in ordinary text, for every ORDER-gram.

    The arguments are counts: which ORDER-gram, of which label, how often. The first symbol of a
    gram is major. Only the result and the shared counts are dense.
    """
    seen = np.zeros(SYMBOLS**ORDER, bool)
    seen[gram] = True
    continued = []  # for each shorter length, after how many symbols a sequence was seen
    for _ in range(ORDER - 1):
        continued.append(seen.reshape(SYMBOLS, -1).sum(0, dtype=np.int32))
        seen = continued[-1] > 0
    shared = np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for counts in reversed(continued):
        rows = counts.reshape(-1, SYMBOLS)
        # A context is backed off to itself without its first symbol.
        shared = _interpolate(rows, np.tile(shared, (len(rows) // len(shared), 1)))
    result = np.empty(SYMBOLS**ORDER, np.float16)
    size = SYMBOLS ** (ORDER - 1)
    for low in range(0, len(result), size):
        inside = (gram >= low) & (gram < low + size)
        logs = []
        for wanted in (1, 0):
            chosen = inside & (label == wanted)
            dense = np.bincount(gram[chosen] - low, n[chosen], size).reshape(-1, SYMBOLS)
            logs.append(np.log(_interpolate(dense, shared)))
        result[low : low + size] = (logs[0] - logs[1]).reshape(-1)
    return result


def _interpolate(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Discounted counts of each row's symbols, and the row's discounts spread as `below` says."""
    total = counts.sum(1, dtype=np.float32, keepdims=True)
    kinds = (counts > 0).sum(1, dtype=np.float32, keepdims=True)
    kept = np.maximum(counts - np.float32(DISCOUNT), 0, dtype=np.float32)
    kept += np.float32(DISCOUNT) * kinds * below
    return np.where(total > 0, kept / np.maximum(total, 1), below)


def features(text: str | None, table: np.ndarray) -> list[float]:
    """Logarithms of the largest log ratio of a word and of the mean of the three largest, the log
    ratio of the whole text by symbol, and the logarithm of the word count."""
    total, letters, words = 0.0, 0, 0
    top = np.zeros(0, np.float32)
    for piece in symbols(text or ""):
        numbers, first = grams(piece)
        if not len(first):
            continue
        found = table[numbers].astype(np.float32)
        total += float(found.sum(dtype=np.float64))
        letters += len(numbers)
        words += len(first)
        top = np.concatenate((top, np.add.reduceat(found, first)))
        if len(top) > 3:
            top = np.partition(top, -3)[-3:]
    if not words:
        return [0.0] * FEATURES
    top = np.maximum(top, 0)
    return [
        float(np.log1p(top.max())),
        float(np.log1p(top.sum() / 3)),
        total / letters,
        float(np.log1p(words)),
    ]


@dataclass
class ToxicityModel:
    """`table`: log ratios of ORDER-grams. `weights`: calibration, the constant last; None if the
    labels have one class only, and then every score is 0. `low` and `high`: the range of each
    feature in the calibration, beyond which it counts as at the end of the range."""

    table: np.ndarray
    weights: np.ndarray | None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """gram, label, fold, n: sums of what each task has counted; at most 4 * SYMBOLS ** ORDER rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple[int, int], list[pd.Series]] = {}
        for batch in batches:
            for (label, fold), rows in batch.groupby(["label", "fold"]):
                held = parts.setdefault((label, fold), [])
                for text in rows["text"]:
                    for piece in symbols(text or ""):
                        numbers, n = np.unique(grams(piece)[0], return_counts=True)
                        held.append(pd.Series(n, numbers))
                    if len(held) >= 256:
                        held[:] = [pd.concat(held).groupby(level=0).sum()]
        for (label, fold), held in parts.items():
            if held:
                sums = pd.concat(held).groupby(level=0).sum()
                yield pd.DataFrame({"gram": sums.index, "label": label, "fold": fold, "n": sums.to_numpy()})

    counted = labelled.select("text", "label", "fold").mapInPandas(
        count, "gram int, label tinyint, fold tinyint, n bigint"
    )
    return counted.groupBy("gram", "label", "fold").agg(F.sum("n").alias("n"))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method, both classes of equal weight in all."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.diag([penalty / len(x) ** 0.5] * (x.shape[1] - 1) + [1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge @ w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored_features(text: Column, table, fold: Column | None = None) -> Column:
    """Features of each text; with a fold, by the table of that number."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, folds in batches:
            yield pd.Series([features(t, table.value[f]) for t, f in zip(texts, folds)])

    return of(text, F.lit(0) if fold is None else fold)


def fit(labelled: DataFrame) -> ToxicityModel:
    """The model of rows text, label (0 or 1; others are left out).

    The n-gram counts are summed by Spark over all rows and collected into tables of fixed size.
    The calibration sees each of its documents through tables that were counted without the half
    of the labelled documents that it belongs to.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("label in (0, 1)").select(
        "text", F.col("label").cast("int").alias("label"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    ).withColumn("fold", F.pmod("key", F.lit(2)).cast("int"))
    # As Arrow: 14 bytes a row, where rows of Python objects take hundreds.
    found = _gram_counts(rows).toArrow()
    gram, label, fold, n = (found[c].to_numpy() for c in ("gram", "label", "fold", "n"))
    del found

    def table_without(left_out: int) -> np.ndarray:
        part = fold != left_out
        return log_ratios(gram[part], label[part], n[part])

    # Only what is needed next is held: the halves' tables go out before the whole one is made.
    shared = spark.sparkContext.broadcast([table_without(0), table_without(1)])
    # A share of all hash values: no sort, and as many rows as wanted if the hashes are even.
    share = min(1.0, CALIBRATED / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 31)) < int(share * (1 << 31)))
    known = sample.select(_scored_features(F.col("text"), shared, F.col("fold")).alias("x"), "label").toPandas()
    shared.destroy()
    table = log_ratios(gram, label, n)
    y = known["label"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(table, None)
    x = np.array(known["x"].tolist(), float)
    return ToxicityModel(table, _fit(x, y), x.min(0), x.max(0))


def toxicity_score(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> Column:
    """Score in [0, 1] of each text; null texts score like empty ones."""
    if model.weights is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast([model.table])
    *weights, constant = model.weights.tolist()
    x = _scored_features(F.col(f"`{text_column}`"), shared)
    sides = {"w": weights, "low": model.low.tolist(), "high": model.high.tolist()}
    return F.aggregate(
        F.arrays_zip(x.alias("x"), *[F.array(*map(F.lit, v)).alias(k) for k, v in sides.items()]),
        F.lit(constant),
        lambda s, p: s + F.least(F.greatest(p["x"], p["low"]), p["high"]) * p["w"],
        lambda s: 1 / (1 + F.exp(-s)),
    )


def held_out(id_column: Column) -> Column:
    """Whether a document's label is kept for evaluation: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """`docs` with held_out, score and predicted (1 from the threshold on), added or replaced.

    `labels` has the id and `toxic` (0 or 1). Labels of held-out ids are never read; of several
    labels of one id the larger counts; a null id has no label. Only texts are scored. Without
    documents of both labels all scores are 0.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("of"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("of is not null and label in (0, 1)").groupBy("of").agg(F.max("label").alias("label"))
    known = known.filter(~held_out(F.col("of")))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    texts = docs.select(F.col(f"`{id_column}`").alias("of"), F.col(f"`{text_column}`").alias("text"))
    model = fit(texts.join(known, "of"))
    return (
        docs.withColumn("score", toxicity_score(docs, model, text_column))
        .withColumn("held_out", held_out(F.col(f"`{id_column}`")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
