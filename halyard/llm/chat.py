"""Formatting of conversations as training text in windows of a token budget.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text
or role are escaped by a backslash after their first character, and one more where
backslashes stand there already, so that reading back is exact. A conversation is
cut into windows along turns by the running sum of the turns' tokens: a window
holds the system turn (a first turn of role ``system``), then up to ``history``
turns of the window before, then as many new turns as the budget allows, one at
least. The loss covers the texts of new assistant turns; what is repeated is masked.

Turns are read in order from sorted partitions and only the current window is held,
so a conversation of any length takes bounded memory.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role, then text, so repeated rows are turns of their own; rows without
conv_id are one conversation; a turn that the budget has no room for, beside the
system turn, makes a window over budget with the system turn alone; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.tokens import encoder
from halyard.llm.workers import tidy

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings (fixed values): this template's, and those of other common ones.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_RESTS})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Characters of windows that one Arrow batch holds, but for a single window.
CHARS = 1 << 21


def escape(text: str) -> str:
    """A text without control strings that ``unescape`` turns back."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read(window: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted window: role, text, and where the escaped text begins and ends."""
    return [(_unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


class _Windows:
    """Cuts one conversation after another into windows, turn by turn."""

    def __init__(self, encode, budget: int, history: int) -> None:
        self.encode, self.budget, self.history = encode, budget, history
        self.conv, self.system = None, None
        self.reset(None)

    def reset(self, conv) -> None:
        self.conv, self.system, self.number, self.turn = conv, None, 0, 0
        self.recent: list[tuple[str, str, int]] = []  # turns of the window before
        self.head: list[tuple[str, str, int]] = []  # repeated turns of this one
        self.new: list[tuple[str, str, int]] = []
        self.total = 0  # running sum of this window's tokens

    def begin(self, size: int) -> None:
        """What the next window repeats: the system turn, and history as far as the budget leaves room beside a new turn of this size."""
        head = [self.system] if self.system else []
        room, kept = self.budget - size - sum(t[2] for t in head), []
        for t in self.recent[::-1][: self.history]:
            if t is self.system or t[2] > room:
                break
            kept.append(t)
            room -= t[2]
        self.head = head + kept[::-1]
        self.total = sum(t[2] for t in self.head)

    def add(self, role: str, text: str) -> Iterator[dict]:
        shown = f"{START}{_escape_role(role)}\n{escape(text)}{END}"
        t = (role, shown, len(self.encode(shown)))
        if self.new and self.total + t[2] > self.budget:
            yield self.close()
            self.begin(t[2])
        if not self.turn and role == "system":
            self.system = t
        self.new.append(t)
        self.total += t[2]
        self.turn += 1

    def close(self) -> dict:
        turns = self.head + self.new
        text, spans = [], []
        at = 0
        for i, (role, shown, _) in enumerate(turns):
            if i >= len(self.head) and role == "assistant":
                spans.append({"start": at + len(START) + len(_escape_role(role)) + 1, "end": at + len(shown) - len(END)})
            text.append(shown)
            at += len(shown)
        row = {"conv_id": self.conv, "window": self.number, "first_turn": self.turn - len(self.new), "repeated": len(self.head), "tokens": self.total, "text": "".join(text), "loss": spans}
        self.recent = self.new
        self.number, self.new, self.head, self.total = self.number + 1, [], [], 0
        return row


def windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 2, ranks: str | None = None) -> DataFrame:
    """conv_id, window, first_turn, repeated, tokens, text, loss (spans of code points) of every window.

    Windows of a conversation lie in one partition, in order. For ``tokenizer`` and ``ranks`` see ``tokens.encoder``.
    """
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, held, begun = _Windows(encoder(tokenizer, ranks), budget, history), [], 0, False
        schema = None
        for batch in batches:
            if schema is None:
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                schema = pa.schema([("conv_id", batch.schema.field(0).type), ("window", pa.int32()), ("first_turn", pa.int64()), ("repeated", pa.int32()), ("tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(span))])
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = []
                if not begun or conv != state.conv:
                    if begun:
                        made.append(state.close())
                    state.reset(conv)
                    begun = True
                made.extend(state.add(role, text))
                for row in made:
                    out.append(row)
                    held += len(row["text"])
                if held >= CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if begun:
            out.append(state.close())
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(tidy(run), f"conv_id {kind.simpleString()}, window int, first_turn long, repeated int, tokens long, text string, loss array<struct<start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """What the windows of ``windows`` say when read back, a row a conversation.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars and
    loss_sha256 (all text under the loss mask, unescaped), formatted_chars.
    """
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            out = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        out.append(told(state))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read(row["text"])[row["repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state:
            yield pa.RecordBatch.from_pylist([told(state)], schema)

    def told(state: list) -> dict:
        return {"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]}

    return found.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
