import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm.token_counts import Vocabulary, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    "a",
    " ",
    "\n\n  \t x",
    "It's we're I'LL don't",
    "aaaaaaaaaaaaaaaaaaaaaaaaaa",
    "héllo wörld ñandú 漢字 😀😀😀 ‍",
    "<|endoftext|>a<|endoftext|><|endoftext|>",
    "12345 67,890.12 -- !!??",
    "ab" * 3000,
    "word " * 4000,
]


def test_counts_equal_the_library():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("abe th'sr\n\té漢😀12<|>", k=rng.randrange(80))) for _ in range(2000)]
    library = Tokenizer.from_file(PATH)
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Vocabulary(PATH).count_texts(texts).tolist() == wanted


def test_pieces_of_long_texts_are_counted_once(monkeypatch):
    from tablewright.llm import token_counts

    monkeypatch.setattr(token_counts, "CHARACTERS", 50)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    library = Tokenizer.from_file(PATH)
    wanted = [len(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert Vocabulary(PATH).count_texts(TEXTS).tolist() == wanted


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(i, t, -1) for i, t in enumerate(TEXTS)] + [(99, None, -1), (1, "a", -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = count_tokens(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    for r in got:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert len(got) == len(rows)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
