import random
import zlib

import numpy as np

from tablewright.llm import toxicity
from tablewright.llm.toxicity import ORDER, SYMBOLS, grams, log_ratios, score_toxicity, symbols


def test_grams_of_words():
    [piece] = symbols("Ab, c1")
    assert piece.tolist() == [1, 2, 0, 0, 3, 27]
    numbers, first = grams(piece)
    assert numbers.tolist() == [1, 2 + 1 * SYMBOLS, 3, 27 + 3 * SYMBOLS]
    assert first.tolist() == [0, 2]
    assert list(symbols("")) == []


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "word " * 40 + "x" * 30
    whole = np.concatenate([grams(p)[0] for p in symbols(text)])
    monkeypatch.setattr(toxicity, "CHARACTERS", 32)
    assert np.concatenate([grams(p)[0] for p in symbols(text)]).tolist() == whole.tolist()


def brute_ratio(counts, gram):
    """Kneser-Ney from its definition, with dictionaries of tuples."""
    seen = {g for c in counts for g in c}
    lower = {}
    for length in range(ORDER - 1, 0, -1):
        longer = seen if length == ORDER - 1 else set(lower[length + 1])
        lower[length] = {}
        for g in longer:
            lower[length][g[1:]] = lower[length].get(g[1:], 0) + 1

    def interpolated(table, g, below):
        row = [n for h, n in table.items() if h[:-1] == g[:-1]]
        if not row:
            return below
        return (max(table.get(g, 0) - 0.75, 0) + 0.75 * len(row) * below) / sum(row)

    p = 1 / SYMBOLS
    for length in range(1, ORDER):
        p = interpolated(lower[length], gram[-length:], p)
    return float(np.log(interpolated(counts[1], gram, p)) - np.log(interpolated(counts[0], gram, p)))


def test_log_ratios_against_the_definition():
    rng = random.Random(1)
    counts = [{tuple(rng.randrange(4) for _ in range(ORDER)): rng.randrange(1, 9) for _ in range(60)} for _ in (0, 1)]

    def number(g):
        return sum(s * SYMBOLS ** (ORDER - 1 - i) for i, s in enumerate(g))

    rows = [(number(g), label, n) for label, c in enumerate(counts) for g, n in c.items()]
    table = log_ratios(*map(np.array, zip(*rows)))
    tried = [*list(counts[0])[:20], *list(counts[1])[:20], (9, 9, 9, 9, 9), (0, 1, 2, 3, 9)]
    for g in tried:
        assert abs(float(table[number(g)]) - brute_ratio(counts, g)) < 0.01


def corpus(spark, n=600):
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeiouthnsrdl", k=rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 80))
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zgruk", "zgrukling", "vexmop"]) + rng.choice(["", "s", "ed"])
        docs.append((i, " ".join(words), -1.0))
        labels.append((i, int(toxic)))
    schema = "doc_id bigint, text string, score double"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = score_toxicity(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    kept = [r for r in rows if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in kept)
    assert right >= 0.95 * len(kept)
    # Labels of held-out rows are never read: turning them around changes nothing.
    held = {r.doc_id for r in kept}
    turned = [(i, 1 - t if i in held else t) for i, t in truth.items()]
    again = score_toxicity(docs, spark.createDataFrame(turned, "doc_id bigint, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}


def test_odd_rows_and_labels(spark):
    docs, labels, _ = corpus(spark, 200)
    odd = spark.createDataFrame([(None, None, 0.0), (5000, "", 0.0), (5001, "zgruk " * 9000, 0.0), (5002, "漢字 ¡!", 0.0)], docs.schema)
    more = spark.createDataFrame([(None, 1), (0, 0), (1, None), (2, 7)], "doc_id bigint, toxic int")
    both = docs.union(odd).union(odd)
    rows = score_toxicity(both, labels.union(more)).collect()
    assert len(rows) == 208 and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in rows if r.doc_id == 5001] == [1, 1]
    assert score_toxicity(both.limit(0), labels).count() == 0
    for nothing in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in score_toxicity(odd, nothing).collect()} == {0.0}
