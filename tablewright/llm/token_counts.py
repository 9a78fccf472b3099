"""Counting byte-level BPE tokens by merging ragged arrays of symbols in step with the ranks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a task remembers; beyond, it starts anew.
REMEMBERED = 1 << 19
#: Characters cut into pre-tokens at a time, so that memory is bounded for long texts.
CHARACTERS = 1 << 20

# The pattern that cuts text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The merges of a tokenizer file as sorted arrays: pair of symbols, rank, merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, before = content["model"], content["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and content["normalizer"] is None
            and before["type"] == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
            and not model.get("ignore_merges")
            and not any(
                t[k]
                for t in content["added_tokens"]
                for k in ("single_word", "lstrip", "rstrip", "normalized")
            )
        )
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        self.bytes = np.array([ids[c] for c in byte_letters()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.merged = pairs[order], order.astype(np.int64), merged[order]
        self.pattern = regex.compile(PATTERN)
        special = sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the sorted merges, or -1."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, at, -1)

    def symbols_left(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each sequence of bytes has after all merges.

        All sequences lie in one array. In every round each sequence finds its pair of lowest rank
        and merges all its occurrences, left to right without overlap; sequences without a pair
        that merges leave the array.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = np.iinfo(np.int64).max
        at = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            at[:-1] = np.where(
                owner[1:] == owner[:-1], self.places(symbols[:-1], symbols[1:]), -1
            )
        while len(symbols):
            rank = np.where(at >= 0, self.ranks[at], none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(owner)])
            alive = np.repeat(lowest < none, sizes)
            if not alive.all():
                out[owner[first]] = sizes
                symbols, owner, at, rank = symbols[alive], owner[alive], at[alive], rank[alive]
                if not len(symbols):
                    break
                keep = lowest < none
                lowest, sizes = lowest[keep], sizes[keep]
            hit = rank == np.repeat(lowest, sizes)
            # In a run of adjacent hits (a pair of two equal symbols) every other one merges.
            if (hit[1:] & hit[:-1]).any():
                index = np.arange(len(hit))
                begins = hit & ~np.r_[False, hit[:-1]]
                run = np.maximum.accumulate(np.where(begins, index, 0))
                hit &= (index - run) % 2 == 0
            symbols[hit] = self.merged[at[hit]]
            stays = ~np.r_[False, hit[:-1]]
            fresh = hit | np.r_[hit[1:], False] | np.r_[hit[2:], False, False][: len(hit)]
            symbols, owner, at, fresh = symbols[stays], owner[stays], at[stays], fresh[stays]
            look = np.flatnonzero(fresh[:-1] & (owner[1:] == owner[:-1]))
            at[:-1][owner[1:] != owner[:-1]] = -1
            at[-1] = -1
            at[look] = self.places(symbols[look], symbols[look + 1])
        return out

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        codes, distinct = pd.factorize(np.array(pieces, dtype=object))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [p for p in distinct if p not in known]
        if new:
            encoded = [p.encode("utf-8", "surrogatepass") for p in new]
            known.update(zip(new, self.symbols_left(encoded).tolist()))
        found = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return found[codes]

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. The pre-tokens of many texts are counted together."""
        total = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        bounds: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pieces:
                sums = np.concatenate(([0], np.cumsum(self.counts(pieces))))
                low = 0
                for text, high in bounds:
                    total[text] += sums[high] - sums[low]
                    low = high
            pieces.clear()
            bounds.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self.special.split(text) if self.special else [text]:
                for match in self.pattern.finditer(part) if len(part) > CHARACTERS else [None]:
                    found = self.pattern.findall(part) if match is None else [match[0]]
                    pieces.extend(found)
                    size += len(part) if match is None else len(match[0])
                    if size >= CHARACTERS:
                        bounds.append((i, len(pieces)))
                        flush()
            bounds.append((i, len(pieces)))
            if self.special:
                total[i] += sum(1 for _ in self.special.finditer(text))
        flush()
        return total


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(text: Column, path: str) -> Column:
    """Tokens of each text by the tokenizer file, which every executor has at `path`. Null: 0.

    Nothing is added in front or behind. Strings of special tokens inside a text count one each.
    """

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(vocabulary(path).count_texts(["" if t is None else t for t in batch]))

    return of(text)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, text_column: str = "text"
) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`), added or
    replaced. A null text is an empty one: no bytes, no tokens. No shuffle; every row stays."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return (
        docs.withColumn("n_tokens", token_counts(text, path))
        .withColumn("n_bytes", F.octet_length(text).cast("bigint"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
