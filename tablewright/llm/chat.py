"""Conversations as training windows of a token budget, with a mask for the loss.

A turn is written as `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed.
Inside roles and texts every `<`, any number of backslashes and `|` get one backslash more, so that
no text can open or close a turn, and the change can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tablewright.llm.token_counts import token_counts

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens that a turn is charged beside its text, for marks, role and line feeds, if the caller does
#: not ask for the written turn to be counted.
TURN_TOKENS = 8
#: Turns of a conversation that are cut into windows at a time.
TURNS_AT_ONCE = 4096

WINDOW_SCHEMA = (
    "window int, text string, repeated int, n_tokens bigint, loss array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _written_turn(role: Column, text: Column) -> Column:
    """A turn as `write_window` writes it."""

    def escaped(column: Column) -> Column:
        return F.regexp_replace(column, r"<(\\*)\|", r"<$1\\|")

    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(OPEN), escaped(plain), F.lit("\n"), escaped(text), F.lit(CLOSE))


def write_window(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[dict[str, int]]]:
    """The text of the turns, and the spans (in code points, end exclusive) of the assistant's
    texts, but for those of the first `repeated` turns."""
    parts, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
        if role == "assistant" and i >= repeated:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_window(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a written window."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        line = text.index("\n", at)
        close = text.index(CLOSE, line + 1)
        turns.append((_unescape_role(text[at + len(OPEN) : line]), unescape(text[line + 1 : close])))
        at = close + len(CLOSE)
    return turns


@dataclass
class _Conversation:
    """The turns of one conversation as they come, cut into windows as soon as that is certain."""

    conv: object
    budget: int
    history: int
    system: tuple[str, str, int] | None = None
    turns: list[tuple[str, str, int]] = field(default_factory=list)
    done: int = 0  # of `turns`, those already in a window
    windows: int = 0

    def add(self, role: str, text: str, tokens: int) -> None:
        if not self.windows and not self.turns and self.system is None and role == "system":
            self.system = (role, text, tokens)
        else:
            self.turns.append((role, text, tokens))

    def cut(self, last: bool) -> Iterator[tuple]:
        """Windows of the turns so far. Unless they are the `last`, the open window waits."""
        sums = np.concatenate(([0], np.cumsum([t[2] for t in self.turns], dtype=np.int64)))
        n, head = len(self.turns), self.system[2] if self.system else 0
        while self.done < n or (last and not self.windows and self.system):
            start = self.done
            # Repeated turns: the latest ones that fit the limit and leave room for the next turn.
            room = self.budget - head - (sums[start + 1] - sums[start] if start < n else 0)
            limit = max(0, min(self.history, room))
            back = int(np.searchsorted(sums, sums[start] - limit, "left")) if self.windows else start
            end = int(np.searchsorted(sums, sums[back] + self.budget - head, "right")) - 1
            end = min(n, max(end, start + 1))
            if end == n and not last:
                break
            turns = [*([self.system] if self.system else []), *self.turns[back:end]]
            repeated = start - back + (1 if self.system and self.windows else 0)
            text, loss = write_window([t[:2] for t in turns], repeated)
            yield self.conv, self.windows, text, repeated, int(sum(t[2] for t in turns)), loss
            self.windows += 1
            self.done = end
        # Turns too far back to be repeated are forgotten.
        keep = int(np.searchsorted(sums, sums[self.done] - self.history, "left"))
        del self.turns[:keep]
        self.done -= keep


def format_conversations(
    turns: DataFrame,
    tokenizer: str,
    budget: int = 1024,
    history: int = 256,
    conv_column: str = "conv_id",
    written: bool = False,
) -> DataFrame:
    """One row per window: the conversation, `window` (0, 1, ...), the written `text`, how many
    turns at its start are `repeated`, n_tokens, and `loss`, the spans that training learns from.

    `turns` has the conversation, turn, role and text. Prefix sums of the tokens of turns choose
    the windows: each holds whole turns of at most `budget` tokens, or the system turn and one turn
    that is too long. Windows after the first open with the system turn, if the conversation begins
    with one, and with the latest turns before that sum to at most `history` tokens. What is repeated is never learnt
    again: each text of an assistant lies in exactly one span.

    With `written`, a turn's tokens are those of the turn as written, with marks, role and escapes,
    so that a window encoded by the tokenizer has n_tokens tokens. Otherwise they are those of its
    plain text and TURN_TOKENS, an estimate for trainers that add the marks to the vocabulary.

    Turns go by turn number, equal ones by role and text; repeated rows are separate turns. Null
    roles and texts are empty. Rows without a conversation form one of their own. A task reads the
    conversations in order and holds a bounded number of turns at a time, however many a
    conversation has. Other columns are left out.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    counted = turns.select(
        F.col(f"`{conv_column}`").alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
    )
    if written:
        tokens = token_counts(_written_turn(F.col("role"), F.col("text")), tokenizer)
    else:
        tokens = token_counts(F.col("text"), tokenizer) + TURN_TOKENS
    counted = counted.withColumn("tokens", tokens)
    dealt = counted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = StructType(
        [StructField("conv", counted.schema["conv"].dataType), *StructType.fromDDL(WINDOW_SCHEMA).fields]
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Conversation | None = None
        for batch in batches:
            rows: list[tuple] = []
            for conv, role_, text_, tokens in _rows(batch, "conv", "role", "text", "tokens"):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        rows += open_.cut(last=True)
                    open_ = _Conversation(conv, budget, history)
                open_.add(role_, text_, tokens)
                if len(open_.turns) >= TURNS_AT_ONCE:
                    rows += open_.cut(last=False)
            yield _batch(rows, arrow)
        if open_ is not None:
            yield _batch(list(open_.cut(last=True)), arrow)

    return dealt.mapInArrow(cut, schema).withColumnRenamed("conv", conv_column)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(name).to_pylist() for name in names])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)


DIGEST_SCHEMA = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(windows: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """Per conversation what its windows hold: the number and the digest of its turns, characters
    and digest of all text under the loss mask, and the characters of the windows.

    The windows must come as `format_conversations` deals them, those of a conversation together
    and in order; they are read as a stream, without another shuffle.
    """
    schema = StructType([windows.schema[conv_column], *StructType.fromDDL(DIGEST_SCHEMA).fields])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def closed() -> tuple:
            conv, n, turns, chars, loss, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            rows = []
            for conv, window, text, repeated, loss in _rows(
                batch, conv_column, "window", "text", "repeated", "loss"
            ):
                if window == 0:
                    if state is not None:
                        rows.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_window(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield _batch(rows, arrow)
        if state is not None:
            yield _batch([closed()], arrow)

    return windows.mapInArrow(digest, schema)
