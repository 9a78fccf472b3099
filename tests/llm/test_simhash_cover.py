import random

import numpy as np
import pytest
import xxhash

from tablewright.functions.staging import staged_count
from tablewright.llm import simhash_cover
from tablewright.llm.simhash_cover import (
    covering_masks,
    drop_near_copies,
    fingerprint,
    links,
    near_duplicates,
)


def brute_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(fps):
    """Smallest id reachable by links of two bits or fewer, over all pairs."""
    ids = sorted(fps)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and group[b] > group[a]:
                    group[b], changed = group[a], True
    return group


def test_fingerprint_of_whole_texts():
    for text in (None, "", " \t\n", "one", "Two Words", "a b a b a b", "É é\u00a0x\x0by z", "x " * 5000):
        assert fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_all_pairs_of_bits():
    masks = covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            flipped = 1 << a | 1 << b
            assert any(not m & ((1 << 64) - 1) & flipped for m in masks)


def test_links_join_the_same_groups_as_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps[:20]):  # chains and crowds of near values, the sign bit among the flipped
        for _ in range(6):
            f ^= 1 << rng.choice([63, *range(64)])
            fps.append(f)
            fps.append(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = links(spark.createDataFrame(signed, "fp bigint")).collect()
    near = {i: f for i, f in enumerate(fps)}
    wanted = brute_components(near)
    place = {s[0]: i for i, s in enumerate(signed)}
    group = dict(enumerate(range(len(fps))))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for r in found:
        assert (fps[place[r.fp]] ^ fps[place[r.least]]).bit_count() <= 2
        a, b = sorted((root(place[r.fp]), root(place[r.least])))
        group[b] = a
    assert {i: root(i) for i in group} == wanted


def test_documents_with_copies_nulls_and_ties(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    texts = [None, "", " ", "a", "A", *base, *base[:3]]
    texts += [b + " " + rng.choice(words) for b in base for _ in range(3)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    wanted = brute_components(fps)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", wanted[r.doc_id])
    assert near_duplicates(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "x")], "doc_id bigint, text string")
    assert [r.component_id for r in near_duplicates(alone).collect()] == [None]


def test_one_near_copy_stays(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(3000)]
    base = [list(rng.choice(words, 150)) for _ in range(8)]
    rows, group, i = [], {}, 0
    for g, tokens in enumerate(base):
        for copy in range(4):
            changed = list(tokens)
            if copy:
                changed[int(rng.integers(150))] = "edited"
            rows.append((i, " ".join(changed), "en", None))
            group[i] = g
            i += 1
    half = base[0][:75] + list(rng.choice(words, 75))  # shares half: no near copy
    rows += [(i, " ".join(half), "en", 1), (i + 1, None, "en", 2), (i + 2, "", "en", 2), (None, "lonely text", None, 3)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted([*range(0, 32, 4), 32, 33])
    assert ids.count(None) == 1
    assert drop_near_copies(docs.limit(0)).count() == 0


def brute_kept(texts):
    """The least number of each group of texts whose five-word shingles are alike by 0.8."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return [i for i in range(len(texts)) if root(i) == i]


def test_truncated_extended_and_edited_copies_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(4000)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, int(rng.integers(40, 300))))
        size = len(base)
        edited = list(base)
        for at in rng.choice(size, max(1, size // 60), replace=False):
            edited[at] = "edited"
        longer = list(rng.choice(words, size // 5))
        cuts = [base[: int(size * share)] for share in (0.9, 0.84, 0.82, 0.75)]
        texts += [" ".join(t) for t in (base, *cuts, base[size // 6 :], base + longer, longer + base, edited)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_kept(texts)


def test_groups_of_near_copies_that_share_boilerplate(spark, monkeypatch):
    """Pairs in one full bucket, whose leader is like neither of them."""

    def starred(texts):
        lead = texts.selectExpr("min(key) a")
        return lead.crossJoin(texts.selectExpr("key b")).filter("a < b")

    monkeypatch.setattr(simhash_cover, "_candidates", starred)
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(4000)]
    shared = list(rng.choice(words, 210))
    texts = []
    for _ in range(60):
        own = list(rng.choice(words, 90))
        texts.append(" ".join(shared + own))
        edited = list(shared)
        for at in (15, 60, 110, 160):
            edited[at + int(rng.integers(20))] = str(rng.choice(words))
        texts.append(" ".join(edited + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wanted = brute_kept(texts)
    assert wanted == list(range(0, 120, 2))
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == wanted


def test_parities_bound_what_only_one_set_has():
    rng = np.random.default_rng(3)
    for size in (0, 1, 30, 900):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for change in (0, 1, 25):
            y = np.unique(np.concatenate((x[change:], rng.integers(0, 1 << 63, change).astype(np.uint64))))
            apart = (simhash_cover.parities(x) ^ simhash_cover.parities(y)).view(np.uint8)
            assert np.unpackbits(apart).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("kind", ["template", "lines", "group"])
def test_pairs_do_not_grow_with_groups(spark, monkeypatch, kind):
    """Texts of one template and texts of common lines share much, but not enough; a group of near
    copies is linked by about one pair a text."""
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(4000)]
    draw = lambda n: list(rng.choice(words, n))
    template, lines = draw(150), [" ".join(draw(10)) for _ in range(40)]
    texts = []
    for _ in range(300):
        if kind == "template":
            texts.append(" ".join(template + draw(30)))
        elif kind == "lines":
            texts.append("\n".join(rng.choice(lines, 10, replace=False)))
        else:
            edited = list(template)
            edited[int(rng.integers(150))] = draw(1)[0]
            texts.append(" ".join(edited))
    listed = []

    def verified(rows, pairs):
        listed.append(pairs.count())
        return own(rows, pairs)

    own = simhash_cover._verified
    monkeypatch.setattr(simhash_cover, "_verified", verified)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_kept(texts)
    assert sum(listed) <= (2 * len(texts) if kind == "group" else 30)


def test_a_large_group_lists_no_more_pairs_than_texts(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if k != i else f"x{i}" for k, w in enumerate(base)) for i in range(0, 160, 4)]
    texts += [f"another text {i} of other words {i * i}" for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed, own = [], simhash_cover._verified

    def verified(rows, pairs):
        listed.append(pairs.count())
        return own(rows, pairs)

    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash_cover, "_candidates", lambda _: none)  # all is left to the shingles
    monkeypatch.setattr(simhash_cover, "_led", lambda *_: none)
    monkeypatch.setattr(simhash_cover, "_verified", verified)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_kept(texts)
    assert 0 < max(listed) <= len(texts)


def test_tables_between_go_when_they_are_used(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(0, 60, 5)] + ["alone", None, ""]
    before = staged_count()
    kept = drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert staged_count() - before <= 10  # of links and keys; 40 and more before
    assert sorted(r.doc_id for r in kept.collect()) == [*brute_kept(texts[:13]), 13]
