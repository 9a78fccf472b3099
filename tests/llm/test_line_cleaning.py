import random
import re
from collections import Counter

import pytest

from tablewright.llm import line_cleaning as rules
from tablewright.llm.line_cleaning import clean_lines

SPACE = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text) if w]


def marks(text, characters):
    return sum(c in characters for c in text)


def rule_of(line, copy):
    w = words(line)
    n, bars = len(w), marks(line, rules.BARS)
    if not n:
        return None
    lowered = line.lower()
    if 10 * marks(line, rules.SYMBOLS + "!") > 3 * n:
        return "symbols"
    if n >= 5 and not re.search("[a-z]", line) and re.search("[A-Z]{2}", line):
        return "shouting"
    if bars >= 3 and 4 * bars > n:
        return "navigation"
    if n < 5 and w[-1][-1] not in rules.CLOSING:
        return "fragment"
    if any(p in lowered for p in rules.NOTICES):
        return "boilerplate"
    if n >= 20 and 5 * len(set(w)) < n:
        return "repetition"
    return "copy" if copy else None


def brute(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    repeated = len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)})
    seen, failed, kept, lost, copies = set(), [], [], 0, 0
    for line in text.split("\n"):
        copy = line in seen
        seen.add(line)
        rule = rule_of(line, copy)
        copies += copy and bool(words(line))
        lost += len(words(line)) if rule else 0
        (failed.append(rule) if rule else kept.append(line))
    base = len(w) < 50 or 100 * repeated > 50 * len(w)
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=marks(text, rules.SYMBOLS), n_dup_lines=copies,
        n_repeat_words=repeated, base_failed=base, kept=not base and 100 * lost <= 30 * len(w),
        lost_words=lost, failed=failed, cleaned="\n".join(kept),
    )


def prose(rng, n, tail="."):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(500)}é" for _ in range(n)) + tail


def texts():
    rng = random.Random(4)
    junk = ["AB C D E F É", "HOME | NEWS | MORE | ABOUT", "x*** y$$$ z###", "WOW!! SO!! GOOD!!", "Contact", "Ok.",
            "We use Cookies on this page of ours.", "so " * 30, "", "  \t", "a\x0bb\x0cc\rd e.", "|•·»› a b c d e f g h"]
    out = [None, "", " ", "\n\n", "one", "one two three one two three", "a b c " * 40, "x\n" * 60, "a\nb\na\nb", "\U0001f600 é|" * 20]
    for i in range(120):
        lines = [prose(rng, rng.randrange(1, 40), rng.choice([".", ".", "!", "", "\"", "…"])) for _ in range(rng.randrange(1, 8))]
        for _ in range(rng.randrange(4)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(junk + lines))
        out.append("\n".join(lines))
    return out + [out[-1]] * 2


def test_equals_brute_force(spark):
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, line string, n int, kept string").repartition(3)
    got = {r.doc_id: r.asDict() for r in clean_lines(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i] == {"doc_id": i, **brute(t)}, repr(t)
    assert {r for g in got.values() for r in g["failed"]} == {
        "symbols", "shouting", "navigation", "fragment", "boilerplate", "repetition", "copy"
    }
    assert {g["kept"] for g in got.values()} == {True, False}


@pytest.mark.parametrize("bits,modulus", [(24, 3), (24, 1), (4, 1 << 40)])
def test_windows_that_share_a_hash_or_are_too_many(spark, monkeypatch, bits, modulus):
    monkeypatch.setattr(rules, "PLACE_BITS", bits)
    real = rules._hash
    monkeypatch.setattr(rules, "_hash", lambda words: real(words) % modulus)
    rows = list(enumerate(t for t in texts() if t))
    got = clean_lines(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "n_repeat_words").collect()
    assert dict(got) == {i: brute(t)["n_repeat_words"] for i, t in rows}


def test_long_texts_take_no_square_of_their_length(spark):
    rng = random.Random(1)
    lines = [prose(rng, 8) for _ in range(30_000)]
    for text in ("\n".join(lines), "a b c d " * 60_000, "same line here.\n" * 60_000):
        [r] = clean_lines(spark.createDataFrame([(None, text)], "doc_id bigint, text string")).collect()
        want = brute(text)
        assert {k: r[k] for k in want if k not in ("failed", "cleaned")} == {k: v for k, v in want.items() if k not in ("failed", "cleaned")}


def test_limits_and_empty_tables(spark):
    df = spark.createDataFrame([(1, prose(random.Random(2), 20)), (1, "X | Y | Z | A\n" + prose(random.Random(3), 20))], "id int, body string")
    got = sorted(clean_lines(df, "id", "body", least_words=5, most_lost=10).collect(), key=lambda r: r.lost_words)
    assert [(r.kept, r.lost_words) for r in got] == [(True, 0), (False, 7)]
    assert clean_lines(df.limit(0), "id", "body").collect() == []


def test_no_python_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    plan = clean_lines(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
