import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import paragraph_sketch
from tablewright.llm.paragraph_sketch import (
    differing_paragraphs,
    fingerprint_documents,
    minus,
    paragraphs,
    peel,
    table_of,
    with_successor,
)


def texts():
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(300)]
    made = ["\n".join(rng.choices(lines, k=rng.randrange(1, 30))) for _ in range(40)]
    return made + [None, "", "\n\n", "é😀\nx", "no break at all " * 50, "\n".join(lines), made[0], made[0] + "\nmore"]


def expected(rows):
    """Brute force over rows (id, text), the next row by id and text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = (set(t.split("\n")) for t in (text, edited, following))
        out.append(
            (
                key,
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                round(len(a & b) / len(a | b), 9),
                round(len(a & c) / len(a | c), 9),
            )
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("together", [2_000, 5])
def test_against_sets_of_paragraphs(spark, monkeypatch, together):
    monkeypatch.setattr(paragraph_sketch, "TOGETHER", together)
    monkeypatch.setattr(paragraph_sketch, "STEP", 3)
    rows = list(enumerate(texts())) + [(None, "nameless"), (7, "a second seven"), (7, "a second seven")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, next string")
    got = fingerprint_documents(docs).collect()
    found = [
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got
    ]
    assert sorted(found, key=str) == expected(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(f) == 1 for f in by_text.values())  # equal texts, equal fingerprints
    assert len({r.fingerprint for r in got}) > 40


def test_tables_give_back_the_differing_digests(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        shared = [f"s{i} {k}" for k in range(rng.randrange(30))]
        a, b = ([f"{side}{i} {k}" for k in range(rng.randrange(9))] for side in "ab")
        rows.append((i, "\n".join(shared + a) or "-", "\n".join(b + shared) or "-"))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    keys = df.select("i", paragraphs(F.col("a")).alias("a"), paragraphs(F.col("b")).alias("b"))
    peeled = peel(minus(table_of(F.col("a")), table_of(F.col("b")))).alias("found")
    wrong = F.array_except(F.col("a")["k"], F.col("b")["k"]), F.array_except(F.col("b")["k"], F.col("a")["k"])
    whole = 0
    for r in keys.select(peeled, wrong[0].alias("x"), wrong[1].alias("y")).collect():
        if r.found is not None:
            whole += 1
            assert {(f.k, f.n) for f in r.found} == {(k, 1) for k in r.x} | {(k, -1) for k in r.y}
    assert whole > 45


@pytest.mark.parametrize("tries", [4, 1, 0])
def test_larger_tables_and_the_last_resort(spark, monkeypatch, tries):
    monkeypatch.setattr(paragraph_sketch, "TRIES", tries)
    monkeypatch.setattr(paragraph_sketch, "PER_TABLE", 40)  # too many for one table now and then
    rows = [(i, "\n".join(f"a{k}" for k in range(i)), "\n".join(f"b{k}" for k in range(3 * i)) + "\na0") for i in range(1, 60, 3)]
    df = spark.createDataFrame(rows, "pair int, a string, b string")
    pairs = df.select("pair", paragraphs(F.col("a")).alias("a"), paragraphs(F.col("b")).alias("b"))
    got = {r.pair: (len(r.differing), sum(d.n for d in r.differing)) for r in differing_paragraphs(pairs).collect()}
    assert got == {i: (i - 1 + 3 * i, i - 1 - 3 * i) for i, _, _ in rows}


def test_successors_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "TOGETHER", 3)
    rows = [(i * 10, f"t{i}") for i in range(50)]
    got = with_successor(spark.createDataFrame(rows, "id bigint, text string").repartition(7)).collect()
    assert {r.id: r.next for r in got} == {i * 10: f"t{(i + 1) % 50}" for i in range(50)}
    for names in ([f"doc{i:05d}" for i in range(50)], ["", "a", "a\0", "b", "zz", "z" * 30, "ä"]):
        named = [(n, f"t{i}") for i, n in enumerate(names)]
        got = with_successor(spark.createDataFrame(named, "id string, text string").repartition(5)).collect()
        assert {r.id: r.next for r in got} == {n: f"t{(i + 1) % len(names)}" for i, n in enumerate(names)}
    with pytest.raises(TypeError):
        with_successor(spark.createDataFrame([(b"a", "t")], "id binary, text string"))
    docs = spark.createDataFrame([(1, "alone"), (2, "b")], "doc_id bigint, text string")
    assert fingerprint_documents(docs.limit(0)).count() == 0
    [r] = fingerprint_documents(docs.filter("doc_id = 1")).collect()
    assert (r.near_next, r.n_chars) == (1.0, 5)
