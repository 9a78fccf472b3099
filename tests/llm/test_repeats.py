import random

import numpy as np
import pytest

from tablewright.functions.staging import staged_count
from tablewright.llm import repeats
from tablewright.llm.repeats import LENGTH, anchors, nearest_smaller, previous_factors, remove_repeats, suffix_levels


def brute(rows, keep):
    """Every LENGTH-byte window of every text, by id and place."""
    seen, order = {}, sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    raw = [(t or "").encode() for _, t in rows]
    for i in order:
        for at in range(len(raw[i]) - LENGTH + 1):
            seen.setdefault(raw[i][at : at + LENGTH], []).append((i, at))
    spans, kept = [], []
    for i in range(len(rows)):
        gone = np.zeros(len(raw[i]), bool)
        for at in range(len(raw[i]) - LENGTH + 1):
            places = seen[raw[i][at : at + LENGTH]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, at)):
                gone[at : at + LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        spans.append([(int(a), int(b)) for a, b in edges.reshape(-1, 2)])
        kept.append(np.frombuffer(raw[i], np.uint8)[~gone].tobytes())
    return spans, kept


def corpus():
    rng = random.Random(12)

    def text(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    passage, exact, short = text(900), text(LENGTH - 40) + "é" * 20, text(380)
    rows = [None, "", "short", exact[:300]]
    rows += [text(rng.randrange(300)) + passage + text(rng.randrange(300)) for _ in range(12)]
    rows += [text(50) + exact + text(60) for _ in range(3)]
    rows += [short, short, text(500) + short + text(300)]
    base = text(1500)
    rows += [base, base, base[:700] + "X" + base[701:], base[:300] + base[310:1200] + text(40)]
    rows += ["z" * 1000, "ab" * 700, text(20) + base[200:900] + "=" + base[200:900]]
    rows += [passage[100:600] + base[:500]]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("keep", "at_once", "piece"), [("none", 256, 1 << 18), ("first", 256, 1 << 18), ("first", 2, 700), ("none", 2, 700)])
def test_against_all_windows(spark, monkeypatch, keep, at_once, piece):
    monkeypatch.setattr(repeats, "SORTED", at_once)
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "TOGETHER", 2000)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string").repartition(5)
    spans, kept = brute(rows, keep)
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in remove_repeats(docs, keep).collect()}
    assert got == {i: (spans[i], kept[i]) for i, _ in rows}


def test_every_suffix_has_one_anchor_of_its_content():
    rng = random.Random(1)
    common = bytes(rng.choices(b"abc", k=700))
    owners = []
    for before in (b"", b"12345", bytes(rng.choices(b"xyz", k=444))):
        raw, found = before + common, {}
        for low, h, place, first, last, _ in anchors(raw):
            for gram, p, a, b in zip(h, place, first, last):
                found.update({low + s: (int(gram), low + int(p) - (low + s)) for s in range(a, b + 1)})
        assert sorted(found) == list(range(len(raw) - LENGTH + 1))
        owners.append([found[len(before) + s] for s in range(len(common) - LENGTH + 1)])
    assert owners[0] == owners[1] == owners[2]


def test_suffix_order_and_factors():
    rng = random.Random(2)
    block = rng.choices(b"abcdef", k=700)
    data = rng.choices(b"ab", k=900) + [97] * 900 + block + block[:550] + [0] + block[250:] + rng.choices(b"ab", k=50)
    data = np.array(data, np.uint8)
    raw = data.tobytes()
    levels = suffix_levels(data)
    assert [d for d, _ in levels] == [8, 16, 32, 64, 128, 256, LENGTH]
    rank = levels[-1][1]
    cut = [raw[i : i + LENGTH] for i in range(len(raw))]
    order = sorted(range(len(raw)), key=lambda i: (rank[i], i))
    assert [cut[i] for i in order] == sorted(cut)

    at = np.arange(len(raw) - LENGTH + 1)
    group = (at >= 1500).astype(int)
    position = np.array(rng.sample(range(10_000), len(at)))
    length, source = previous_factors(levels, data, at, group, position)

    def common(i, j):
        n = int(np.argmin(data[i : i + LENGTH] == data[j : j + LENGTH]))
        return LENGTH if cut[i] == cut[j] else n

    for i in range(0, len(at), 7):
        before = np.flatnonzero((group == group[i]) & (position < position[i]))
        assert length[i] == max((common(i, j) for j in before), default=0)
        if length[i]:
            assert source[i] in before and common(i, source[i]) == length[i]
        else:
            assert source[i] == -1
    assert 0 < (length == LENGTH).sum() < len(at)


def test_nearest_smaller_values():
    rng = random.Random(4)
    for n in (0, 1, 2, 50):
        for value in (rng.sample(range(100), n), list(range(n)), list(range(n))[::-1]):
            between = [rng.randrange(9) for _ in value[1:]]
            to, least = nearest_smaller(np.array(value, int), np.array(between, int))
            for i in range(n):
                expected = next((j for j in range(i - 1, -1, -1) if value[j] < value[i]), -1)
                assert to[i] == expected
                assert least[i] == (min(between[expected:i]) if expected >= 0 else 0)


def test_joins_with_and_without_heavy_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(0 if i < 40 else i, i) for i in range(60)], "k bigint, v bigint")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k < 50")
    for parts in (1, 4, 1000):
        monkeypatch.setattr(repeats, "HEAVY", parts)
        got = repeats._join_counted(rows, counted, ["k"], 60).select("k", "n", "v").collect()
        assert sorted(map(tuple, got)) == [(0 if i < 40 else i, 40 if i < 40 else 1, i) for i in range(50)]


def test_place_hash_is_the_one_of_spark(spark):
    from pyspark.sql import functions as F

    rows = [(-5, 0), (1 << 62, 400), (-(1 << 63), 7)]
    got = spark.createDataFrame(rows, "k bigint, at bigint").select(F.xxhash64("k", "at")).collect()
    assert [r[0] % (1 << 64) for r in got] == [repeats._place_hash(*r) for r in rows]


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(random.Random(3).choices("abcdef", k=600))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x" * 500), (None, None)], "doc_id bigint, text string")
    none = remove_repeats(docs, "none").collect()
    assert sorted(len(r.kept) for r in none) == [0, 0, 0, 0]
    first = remove_repeats(docs, "first").collect()
    # Of 500 equal bytes the first 400 are new; the other windows begin one place later.
    assert sorted(len(r.kept) for r in first) == [0, 1, 600, 600]
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, "last")


def test_tasks_hold_few_bytes_and_tables_go(spark, monkeypatch):
    """Of texts of 8 MB in one partition a task holds 4 MB at a time; only what is still read stays staged."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdef ", k=1 << 18))
    rows = [(i, f"{i} {text[i * 5000:]}{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    held = []

    def sized(batches):
        for batch in batches:
            yield batch[["text"]].agg(lambda t: t.str.len().sum()).to_frame("n").reset_index(drop=True)

    def measured(texts):
        held.extend(r.n for r in texts.select("text").mapInPandas(sized, "n bigint").collect())
        return own(texts)

    own = repeats._repeated_buckets
    monkeypatch.setattr(repeats, "_repeated_buckets", measured)
    before, batches = staged_count(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = remove_repeats(docs, "first")
    assert len(held) > 1 and max(held) <= 5 << 20
    assert staged_count() - before <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batches
    kept = {r.doc_id: len(r.kept) for r in found.collect()}
    assert kept[0] == len(rows[0][1]) and max(kept[i] for i in range(1, 40)) < 400
