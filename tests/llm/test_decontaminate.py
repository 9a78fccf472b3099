import random

import numpy as np

from tablewright.llm import decontaminate
from tablewright.llm.decontaminate import (
    align,
    contaminated_documents,
    remove_contaminated,
    word_hashes,
)


def brute_align(words, item):
    best, table = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i][j] = max(
                0,
                table[i - 1][j - 1] + (2 if a == b else -1),
                table[i - 1][j] - 1,
                table[i][j - 1] - 1,
            )
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_plain_table(monkeypatch):
    rng = random.Random(3)
    pairs = [
        (rng.choices(range(6), k=rng.randrange(0, 25)), rng.choices(range(6), k=rng.randrange(1, 12)))
        for _ in range(200)
    ]
    words, items = ([np.array(x, np.int32) for x in side] for side in zip(*pairs))
    wanted = [brute_align(w, i) for w, i in pairs]
    assert align(words, items)[0].tolist() == wanted
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    assert align(words, items)[0].tolist() == wanted


def test_words_and_pieces(monkeypatch):
    text = "One two, THREE-four\n" + "naïve 漢字 " * 30 + "x" * 50
    whole = word_hashes(text)
    assert len(whole) == 4 + 60 + 1
    assert word_hashes("one TWO three; four")[:4].tolist() == whole[:4].tolist()
    assert len(word_hashes(None)) == len(word_hashes("")) == len(word_hashes(" -- ")) == 0
    monkeypatch.setattr(decontaminate, "BYTES", 64)
    assert word_hashes(text).tolist() == whole.tolist()


def tables(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(15, 50)))) for i in range(30)]
    items += [(30, "two words"), (31, ""), (32, None), (None, "an item without any id at all"), (3, items[3][1])]
    docs, wanted = [], set()

    def add(text, *hits):
        wanted.update((len(docs), h) for h in hits)
        docs.append((len(docs), text, "row"))

    def filler(n):
        return " ".join(rng.choices(vocabulary, k=n))

    for i in range(10):
        add(f"{filler(40)} {items[i][1]} {filler(30)}", i)  # as it is
        add(f"{filler(3000)}. {items[i][1].upper()}!! {filler(2000)}", i)  # long text, other case
        words = items[i][1].split()
        for at in range(0, len(words), 9):  # edited
            words[at] = "changed"
        del words[len(words) // 2]
        add(f"{filler(20)} {' '.join(words)} {filler(20)}", i)
        half = items[i][1].split()[: len(items[i][1].split()) // 3]
        add(f"{filler(50)} {' '.join(half)} {filler(50)}")  # a third is no copy
    for _ in range(60):  # a passage that most documents quote is found in all of them
        add(f"{filler(30)} {items[20][1]} {filler(5)}", 20)
    add(f"{items[21][1]} {items[22][1]}", 21, 22)
    add("just two words")  # an item shorter than a seed is found in a text of its words alone
    add("Two words!", 30)
    add("AN ITEM without any ID at all", None)
    for _ in range(40):
        add(filler(200))
    add(None)
    add("")
    schema = "doc_id bigint, text string, key string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id bigint, text string"), wanted


def test_copies_edited_copies_and_hot_passages(spark):
    docs, items, wanted = tables(spark)
    got = contaminated_documents(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted
    assert len(got) == len(wanted) and all(0.6 <= r.similarity <= 1 for r in got)
    kept = remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = set(range(docs.count())) - {d for d, _ in wanted}
    assert {r.doc_id for r in kept.collect()} == clean


def test_odd_tables(spark):
    docs, items, wanted = tables(spark)
    hit, miss = min(d for d, _ in wanted), docs.count() - 1
    rows = docs.filter(f"doc_id in ({hit}, {miss})")
    nameless = rows.selectExpr("cast(null as bigint) doc_id", "text", "key")
    twice = rows.union(rows).union(nameless)
    assert sorted(str(r.doc_id) for r in remove_contaminated(twice, items).collect()) == [str(miss)] * 2 + ["None"]
    assert contaminated_documents(docs.limit(0), items).count() == 0
    assert contaminated_documents(docs, items.limit(0)).count() == 0
    assert remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_edited_copies_beside_exact_ones(spark):
    """Every third and fourth word replaced, or random ones: the verdict is that of the alignment."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(2000)]
    items = [(i, rng.choices(vocabulary, k=size)) for i, size in enumerate((40, 15, 12, 60, 25))]
    docs = []
    for _, words in items:
        docs += [list(words) for _ in range(3)]
        for step in (3, 4):
            docs.append([f"new{at}" if at % step == step - 1 else w for at, w in enumerate(words)])
        for share in (0.1, 0.2, 0.25):
            gone = set(rng.sample(range(len(words)), int(share * len(words))))
            docs.append([f"new{at}" if at in gone else w for at, w in enumerate(words)])
    texts = [" ".join(rng.choices(vocabulary, k=20) + d + rng.choices(vocabulary, k=20)) for d in docs]
    wanted = {
        (d, i)
        for d, text in enumerate(texts)
        for i, words in items
        if brute_align(text.split(), words) >= 0.6 * 2 * len(words)
    }
    assert (4, 0) in wanted  # every fourth word of forty, beside exact copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated_documents(docs, table).collect()} == wanted


def test_long_items_with_a_replaced_run(spark):
    """Seeds of one item lie hundreds of words apart; what counts is the alignment of the whole item."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(5000)]
    items, docs, wanted = [], [], set()
    for which, size in enumerate((100, 400, 1000)):
        item = rng.choices(words, k=size)
        items.append((which, " ".join(item)))
        for share in (0.1, 0.2, 0.25, 0.32, 0.5):
            low = size * 3 // 8
            run = int(size * share)
            text = rng.choices(words, k=80) + item[:low] + rng.choices(words, k=run) + item[low + run :] + rng.choices(words, k=80)
            if brute_align(text, item) >= 0.6 * 2 * size:
                wanted.add((len(docs), which))
            docs.append((len(docs), " ".join(text)))
    assert (7, 1) in wanted and len(wanted) >= 9
    found = contaminated_documents(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in found.collect()} == wanted
