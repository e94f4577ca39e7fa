"""Chat formatting: conversations cut into turn-aligned windows of a token budget.

A conversation's rows are read in turn order in one task and streamed, so memory holds one window. Running sums of turn
tokens decide where a window ends: before the turn that would exceed ``budget``. The next window repeats the system
turn and the latest turns that fit into ``history`` tokens. The loss mask covers each assistant text where it is new
and never where it is repeated. A turn longer than the budget stays whole in a window of its own.

A turn is ``<s>role[INST]text[/INST]</s>``; in roles and texts, backslashes are doubled and a backslash parts the first
character of each control string from the rest, which reading back undoes.

Null texts and roles are empty, null turns come first, rows that share a turn are ordered by role and text, null
conversation ids form one conversation. Repeated rows are repeated turns. An empty table gives no windows. Extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ENCODINGS: dict = {}


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


class _Windows:
    """Cuts one conversation's turns into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.turns, self.used, self.fresh, self.repeated, self.number = None, [], 0, 0, 0, 0

    def add(self, role, text, tokens):
        """The window that this turn closes, if any."""
        closed = None
        if self.fresh and self.used + tokens > self.budget:
            closed = self.window()
            kept, left = [], self.history
            for turn in reversed(self.turns):
                if turn is self.system or turn[2] > left:
                    break
                kept.append(turn)
                left -= turn[2]
            head = [self.system] if self.system else []
            room = self.budget - tokens - (self.system[2] if self.system else 0)
            while kept and sum(t[2] for t in kept) > room:
                kept.pop()
            self.turns = head + kept[::-1]
            self.repeated, self.fresh, self.used = len(self.turns), 0, sum(t[2] for t in self.turns)
        turn = (role, text, tokens)
        if role == "system" and self.system is None:
            self.system = turn
        self.turns.append(turn)
        self.fresh += 1
        self.used += tokens
        return closed

    def window(self):
        """(number, text, flat loss spans in characters, repeated turns, tokens)"""
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.turns):
            head, body = f"<s>{escape(role)}[INST]", escape(text)
            if i >= self.repeated and role == "assistant":
                loss += [at + len(head), at + len(head) + len(body)]
            parts.append(f"{head}{body}[/INST]</s>")
            at += len(parts[-1])
        self.number += 1
        return self.number - 1, "".join(parts), loss, self.repeated, self.used


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """``conv_id, window, text, loss`` (flat start, end pairs in code points) ``, repeated, tokens``."""
    import pyarrow as pa

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.int32())), ("repeated", pa.int32()), ("tokens", pa.int64())])

    def made(batches):
        count = _encoding(tokenizer).encode_ordinary
        current, cutter = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if cutter is None or conv != current:
                    if cutter:
                        out.append((current, *cutter.window()))
                    current, cutter = conv, _Windows(budget, history)
                closed = cutter.add(role, text, len(count(text)))
                if closed:
                    out.append((conv, *closed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kind)], schema=kind)
        if cutter:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((current, *cutter.window()), kind)], schema=kind)

    return _in_order(rows, "turn", "role", "text").mapInArrow(made, "conv_id long, window int, text string, loss array<int>, repeated int, tokens long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from windows alone: digests of the turns and of the text under the loss mask."""
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    rows = formatted.select("conv_id", "window", "text", "loss", "repeated")

    def made(batches):
        state = None
        for b in batches:
            out = []
            for conv, _, text, loss, repeated in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if state is None or conv != state[0]:
                    if state:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, m in enumerate(TURN.finditer(text)):
                    if i >= repeated:
                        state[1] += 1
                        state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for start, end in zip(loss[::2], loss[1::2]):
                    said = unescape(text[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
                state[6] += 1
            if out:
                yield batch(out)
        if state:
            yield batch([state])

    def batch(states):
        columns = [*zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in s] for s in states])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(columns, names)], names=names)

    return _in_order(rows, "window").mapInArrow(
        made, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
