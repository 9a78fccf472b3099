import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tablewright.llm import collocations as module
from tablewright.llm.collocations import blocks, collocations, frequent_phrases, prepared
from pyspark.sql import functions as F


def lists(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", text)]


def counted(rows, longest):
    """Occurrences by language of phrases and, as '', of all words."""
    found = {}
    for text, lang in rows:
        own = found.setdefault(lang or "und", Counter())
        for w in lists(text):
            own[""] += len(w)
            for k in range(1, longest + 1):
                own.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return found


def brute(rows, threshold, longest, percent=100, first=2000):
    out = []
    for lang, f in counted(rows, longest).items():
        n = f.pop("")
        candidates = {p: a for p, a in f.items() if a >= threshold and " " in p}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and f" {p} " in f" {q} "]
            if any(100 * b >= percent * a for b in longer):
                continue
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), p, left, right))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p, -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    full = [(t, g, "x", 1) for t, g in rows]
    return spark.createDataFrame(full, "text string, lang string, phrase string, n int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = [f"W{i}" for i in range(40)] + ["é", "the", "of", "a b", "x|y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = "in the Beginning was the word and the word was"
    rows = []
    for i in range(260):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        if i % 3 == 0:
            words[len(words) // 2 : 0] = fixed.split()
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ; "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), ("alone", "xx"), (" \t.,", "yy")] + [("same again " * 30, "en")] * 7


@pytest.mark.parametrize("threshold,longest,shards", [(20, 5, 4), (60, 3, 1), (10, 4, 3), (25, 2, 2)])
def test_equals_brute_force(spark, rows, threshold, longest, shards):
    df = frame(spark, rows).repartition(5)
    got = collocations(df, threshold=threshold, longest=longest, shards=shards)
    assert sorted(map(tuple, got.collect())) == brute(rows, threshold, longest)


def test_limits_and_percent(spark, rows):
    df = frame(spark, rows).repartition(3)
    got = collocations(df, threshold=15, percent=60, first=7, longest=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 15, 4, percent=60, first=7)


@pytest.mark.parametrize("slots", [1 << 20, 64, 1])
def test_counts_are_exact_however_few_the_slots(spark, rows, slots):
    df = frame(spark, rows).repartition(6)
    prep = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), prepared(F.col("text")).alias("text"))
    got = {(r.lang, r.phrase): r.n for r in frequent_phrases(prep, 12, 4, 3, slots).collect()}
    want = {
        (lang, p): n for lang, f in counted(rows, 4).items() for p, n in f.items() if (n >= 12 or p == "") and n > 0
    }
    assert got == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("ab") * rng.randrange(1, 4) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(400))
    monkeypatch.setattr(module, "CHUNK", 37)
    tables = {k: np.zeros(256, np.uint8) for k in range(1, 5)}
    found = Counter()
    for texts in ([text], [text, "", "a a"], ["b" * 100, text]):
        found.clear()
        for block, ahead in blocks(iter(texts), 5):
            # Step 1 of 2 shards: words still count, and phrases whose parts were reached in step 0.
            for part in module.count_block("en", module.Block.of("en", block, ahead), 1, 2, 5, tables, 256):
                found.update(dict(zip(part["phrase"], part["n"])) if part["phrase"].is_unique else {None: 1})
        assert found == counted([(t, "en") for t in texts], 5)["en"]


def test_trimming_keeps_what_lies_inside_known_phrases(monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 21)
    slots = 1 << 20
    text = " ".join(["a b c", "x1", "a b c d", "x2 x3", "a b", "x4", "c a b c\na b c"] * 6)
    pairs = ["a b", "b c", "c a"]
    tables = {k: np.full(slots, module.NEVER, np.uint8) for k in (1, 2)}
    for k, known in ((1, "abcd"), (2, pairs)):
        for phrase in known:
            block = module.Block.of("en", phrase, "")
            h = block.hash_of[block.codes]
            h = h[:1] if k == 1 else module._extended(h[:1], h[1:2])
            tables[k][module._slots(h, slots)] = 2
    parts, follows = [], False
    for body, ahead in blocks(iter([text]), 5):
        parts.append(module.trim_block(module.Block.of("en", body, ahead), follows, 3, 4, 2, tables, slots))
        follows = bool(ahead)
    kept = "".join(parts)
    f, g = (counted([(t, "en")], 3)["en"] for t in (text, kept))
    assert [g[p] for p in ("a b c", "c a b")] == [f[p] for p in ("a b c", "c a b")] and f["a b c"] == 24
    assert g[""] < f[""] and all(g[p] <= n for p, n in f.items()) and set(g) <= set(f)


def test_equal_hashes_of_different_phrases(monkeypatch):
    codes = np.array([0, 1, 0, 1, 2, 1])
    words = np.array(["a", "b", "c"], dtype=object)
    places, since = np.array([0, 2, 4]), np.ones(5, np.int64)
    [part] = module._phrases("en", words, codes, places, 2, np.zeros(3, np.uint64), since, 8)
    assert dict(zip(part["phrase"], part["n"])) == {"a b": 2, "c b": 1}
    assert isinstance(part, pd.DataFrame)


def test_empty_tables_and_wrong_limits(spark, rows):
    df = frame(spark, rows)
    assert collocations(df.limit(0)).collect() == []
    assert collocations(df.filter("text is null")).collect() == []
    for wrong in ({"longest": 1}, {"threshold": 0}, {"shards": 0}):
        with pytest.raises(ValueError):
            collocations(df, **wrong)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    found = spark.createDataFrame(
        [("en", "", 0, big * 10), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big // 7)],
        "lang string, phrase string, words int, n bigint",
    )
    [r] = module.scored(found, 1000).collect()
    assert r.score == 1000 * (big // 7) * big * 10 // (big * (big - 1))
