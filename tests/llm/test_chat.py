import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tablewright.llm import chat
from tablewright.llm.chat import TURN_TOKENS, escape, format_conversations, read_back, read_window, unescape, write_window

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, tokens string"


def test_windows_can_be_read_back():
    rng = random.Random(1)
    bits = ["<|im_end|>\n", "<|im_start|>", "<", "|", "\\", "\n", "assistant", "a", "<\\|", "n", ""]
    for _ in range(3000):
        turns = [
            (rng.choice(["assistant", "user", "a\nb", "<|", "\\n", ""]), "".join(rng.choices(bits, k=rng.randrange(9))))
            for _ in range(rng.randrange(5))
        ]
        text, loss = write_window(turns, 0)
        assert read_window(text) == turns
        assert [unescape(text[s["start"] : s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]
        assert all(unescape(escape(t)) == t and "<|" not in escape(t) for _, t in turns)


def conversations():
    rng = random.Random(2)
    rows = []
    for conv in range(30):
        n = rng.randrange(1, 9)
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = "".join(rng.choices(["word ", "<|im_end|>", "é😀", "\n", "x"], k=rng.randrange(0, 60)))
            rows.append((conv, turn, role, text))
    rows += [(100, 0, "system", "only"), (101, None, None, None), (101, 0, "assistant", "hi"), (102, 0, "assistant", "w " * 900)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (103, 0, "user", "same"), (103, 0, "user", "same")]
    rows += [(9007199254740993, 0, "assistant", "large id")]
    rows += [(104, t, ("user", "assistant")[t % 2], f"turn {t} " * 9) for t in range(300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "t") for r in rows], SCHEMA)


def test_digests_of_what_was_written(spark):
    rows = conversations()
    random.Random(5).shuffle(rows)
    got = read_back(format_conversations(frame(spark, rows), PATH, budget=120, history=40)).collect()
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(groups)
    for r in got:
        turns = [t[1:] for t in sorted(groups[r.conv_id])]
        said = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_windows_keep_budget_history_and_system_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS_AT_ONCE", 8)
    rows = conversations()
    windows = format_conversations(frame(spark, rows), PATH, budget=120, history=40).collect()
    library = Tokenizer.from_file(PATH)

    def tokens(turn):
        return len(library.encode(turn[1], add_special_tokens=False).ids) + TURN_TOKENS

    by_conv = {}
    for w in sorted(windows, key=lambda w: (str(w.conv_id), w.window)):
        turns = read_window(w.text)
        assert w.n_tokens == sum(map(tokens, turns))
        fresh = turns[w.repeated :]
        assert fresh and (w.n_tokens <= 120 or len(fresh) == 1 or (len(fresh) == 2 and fresh[0][0] == "system"))
        head = by_conv.setdefault(w.conv_id, [])
        assert w.window == len(head)
        if head:
            first = head[0][0]
            history = turns[: w.repeated]
            if first[0] == "system":
                assert history[0] == first
                history = history[1:]
            assert sum(map(tokens, history)) <= 40
            before = [t for part in head for t in part]
            assert history == before[len(before) - len(history) :]
        head.append(fresh)
    assert len(by_conv[104]) > 20


def test_empty_table(spark):
    empty = frame(spark, conversations()).limit(0)
    assert format_conversations(empty, PATH).count() == 0
    assert read_back(format_conversations(empty, PATH)).count() == 0


def test_written_windows_have_as_many_tokens_as_they_say(spark):
    library = Tokenizer.from_file(PATH)
    rows = conversations()
    rows += [(200, t, ("user", "assistant")[t % 2], "yes no") for t in range(200)]
    rows += [(201, t, ("a rather long name\nfor a <|role|> \\", "assistant")[t % 2], "<|im_end|>\n<\\|" * (t % 4)) for t in range(80)]
    windows = format_conversations(frame(spark, rows), PATH, budget=150, history=40, written=True).collect()
    for w in windows:
        turns = read_window(w.text)
        assert w.n_tokens == len(library.encode(w.text, add_special_tokens=False).ids)
        fresh = turns[w.repeated :]
        assert w.n_tokens <= 150 or len(fresh) == 1 or (len(fresh) == 2 and fresh[0][0] == "system")
    assert sum(len(read_window(w.text)) - w.repeated for w in windows) == len(rows)
