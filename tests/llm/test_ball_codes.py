import hashlib
import math

import numpy as np
import pytest

from tablewright.functions import staging
from tablewright.llm import ball_codes
from tablewright.llm.ball_codes import learn_codes, nearest, neighbours, part_bounds, whole_numbers, with_label_error


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (id, vector) in order of id: code and error of each, and all components of the entries."""
    vectors = [[math.floor(scale * x) for x in v] for _, v in rows]
    codes, books = [[] for _ in rows], []
    errors = [0] * len(rows)
    for a, b in part_bounds(len(vectors[0]), parts):
        points = [v[a:b] for v in vectors]
        book = [list(p) for p in points[:entries]]

        def choose():
            found = [min((sum((x - y) ** 2 for x, y in zip(p, e)), j) for j, e in enumerate(book)) for p in points]
            return found

        for _ in range(rounds):
            held = [j for _, j in choose()]
            for j in range(len(book)):
                own = [p for p, h in zip(points, held) if h == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own)]
        for i, (d, j) in enumerate(choose()):
            codes[i].append(j)
            errors[i] += d
        books.append(book)
    return codes, errors, [x for book in books for e in book for x in e]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string, extra int")


def compare(spark, rows, **options):
    rows = sorted(((i, [float(np.float32(x)) for x in v], label) for i, v, label in rows), key=lambda r: r[:2])
    codes, errors, numbers = brute([r[:2] for r in rows], **options)
    df = frame(spark, [(*r, "x", 1) for r in rows]).repartition(3)
    coded, books = learn_codes(df, **options)
    got = sorted((r.id, r.error, list(r.code)) for r in coded.collect())
    assert got == sorted((r[0], e, c) for r, e, c in zip(rows, errors, codes))
    assert books.digest() == hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return coded, errors


def test_equals_all_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(int(i), (centres[i % 20] + rng.normal(scale=0.3, size=16)).tolist(), int(i % 3)) for i in rng.permutation(400)]
    coded, errors = compare(spark, rows)
    by_label = {}
    for (i, _, label), e in zip(sorted(rows), errors):
        by_label[label] = by_label.get(label, 0) + e
    got = with_label_error(coded).collect()
    assert len(got) == 400 and all(r.label_error == by_label[r.label] for r in got)


def test_ties_repeated_rows_and_unused_entries(spark):
    # Whole numbers on a small grid: many equal distances, equal entries and empty balls.
    rng = np.random.default_rng(4)
    rows = [(i // 2, (rng.integers(-2, 3, size=10) / 4096).tolist(), None) for i in range(120)]
    compare(spark, rows, parts=4, rounds=3)
    compare(spark, [(7, [0.5] * 8, 1)] * 40, entries=5)
    compare(spark, rows[:9], parts=3, entries=16)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 6)).tolist(), 1) for i in range(60)]
    compare(spark, rows, entries=4, rounds=2)
    df = frame(spark, [(i, [3e38 * (-1) ** i] * 8, 1, "", 1) for i in range(6)])
    coded, _ = learn_codes(df, entries=1, rounds=1)
    assert [r.error for r in coded.collect()] == [None] * 6
    assert [r.label_error for r in with_label_error(coded).collect()] == [None] * 6


def test_rows_without_a_usable_vector_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, -inf], 2), (5, [1.0, 2.0], None),
            (None, [3.0, 4.0], None), (6, [1.0, 2.0, 3.0], 1)]
    df = frame(spark, [(*r, "x", 1) for r in rows])
    coded, books = learn_codes(df, parts=2)
    got = {r.id: (r.error, r.label_error, list(r.code)) for r in with_label_error(coded).collect()}
    assert got == {5: (0, 0, [0, 0]), None: (0, 0, [1, 1])}
    for empty in (df.limit(0), df.filter("vec_id < 5")):
        coded, books = learn_codes(empty)
        assert with_label_error(coded).collect() == [] and books.entries == []
        assert books.digest() == hashlib.sha256(b"").hexdigest()
    coded, _ = learn_codes(frame(spark, [(1, [], 1, "x", 1), (2, [], 1, "x", 1)]))
    assert [(r.error, list(r.code)) for r in coded.collect()] == [(0, [0] * 8)] * 2
    with pytest.raises(ValueError):
        learn_codes(df, entries=257)


def test_rings_spare_distances_and_lose_none(monkeypatch):
    rng = np.random.default_rng(6)
    entries = whole_numbers(rng.normal(size=(16, 8)) * 4, 4096)
    points = whole_numbers(np.repeat(entries / 4096, 50, axis=0) + rng.normal(scale=0.1, size=(800, 8)), 4096)
    held = np.repeat(np.arange(16), 50)
    radii = [int(ball_codes._distance(points[held == j], entries[j]).max()) for j in range(16)]
    measured = []
    real = ball_codes._distance
    monkeypatch.setattr(ball_codes, "_distance", lambda p, e: measured.append(len(p)) or real(p, e))
    found, error = nearest(points, held, entries, neighbours(entries, radii))
    every = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (error == every.min(1)).all()
    assert sum(measured) < 800 * 16 / 4


def test_two_rounds_are_kept(spark):
    before = staging.staged_count()
    rows = [(i, [float(i), 1.0], 1, "x", 1) for i in range(30)]
    learn_codes(frame(spark, rows), parts=2, rounds=4)
    assert staging.staged_count() == before + 1  # the codes
