"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums, the system turn kept, history repeated, its targets masked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 1024
HISTORY = 256
_PIECE = re.compile(r"\w+|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string survives in a text: each ``<|`` gets a backslash inside, backslashes are doubled."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def pieces(text: str) -> int:
    """Words and marks, plus four for the template around a turn."""
    return len(_PIECE.findall(text)) + 4


class _Windows:
    """Windows of one conversation, made as its turns go by; held are the system turn, the open window and turns that may be repeated."""

    def __init__(self, conv: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, str, int] | None = None
        self.fresh: list[tuple[str, str, int]] = []
        self.past: list[tuple[str, str, int]] = []
        self.sums = [0]  # tokens of the fresh turns up to each
        self.number = self.turn = 0

    def _head(self) -> list[tuple[str, str, int]]:
        """The system turn and the longest run of latest turns within the history's share."""
        room, first = self.history, len(self.past)
        while first and self.past[first - 1][2] <= room:
            first -= 1
            room -= self.past[first][2]
        self.past = self.past[first:]
        return [self.system] * (self.system is not None and self.turn > len(self.fresh)) + self.past

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        head = sum(t for _, _, t in self._head())
        if self.fresh and head + self.sums[-1] + tokens > self.budget:
            yield self._close()
        self.fresh.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        self.turn += 1
        if self.turn == 1 and role == "system":
            self.system = self.fresh[0]

    def _close(self) -> tuple:
        head, parts, at, spans = self._head(), [], 0, []
        for n, (role, text, _) in enumerate(head + self.fresh):
            before, body = f"{START}{escape_role(role)}\n", escape(text)
            if n >= len(head) and role == "assistant":
                spans.append((at + len(before), at + len(before) + len(body)))
            parts += [before, body, END]
            at += len(before) + len(body) + len(END)
        row = (self.conv, self.number, self.turn - len(self.fresh), len(head), "".join(parts), [s for s, _ in spans], [e for _, e in spans])
        self.past += [t for t in self.fresh if t is not self.system]
        self.fresh, self.sums, self.number = [], [0], self.number + 1
        return row

    def end(self) -> Iterator[tuple]:
        if self.fresh:
            yield self._close()


_SCHEMA = "conv_id long, window long, first_turn long, repeated long, formatted string, loss_start array<long>, loss_end array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = pieces) -> DataFrame:
    """``conv_id, window, first_turn, repeated, formatted, loss_start, loss_end``: windows of whole turns within ``budget`` tokens.

    Each window starts with its ``repeated`` turns, the system turn (if the conversation starts with one) and up to ``history`` tokens of
    the latest turns, and goes on with new turns while they fit; a turn that alone exceeds the budget has a window of its own and is not
    cut. The loss spans are the escaped texts of new assistant turns, so every one is a target once. ``count`` gives a text's tokens.

    Turns go by ``turn`` (nulls first), then role and text. Null roles and texts are empty; null ids form one conversation. A
    conversation passes through one task in order, a turn at a time, and only its open window is held. Extra columns are not read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Windows | None = None
        names = _SCHEMA.replace(",", "").split()[::2]
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv != conv:
                    out += now.end() if now else []
                    now = _Windows(conv, budget, history)
                out += now.add(role, text, count(text))
            yield _batch(out, _TYPES, names)
        if now:
            yield _batch(list(now.end()), _TYPES, names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, body = piece.removesuffix(END).partition("\n")
        turns.append((unescape_role(role), unescape(body)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows`` of each conversation, from its windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        conv, begun, state = None, False, None

        def close() -> tuple:
            n, turns, chars, loss, size, count = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        out.append(close())
                    conv, begun, state = row["conv_id"], True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(row["formatted"])[row["repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                    target = unescape(row["formatted"][a:b])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(row["formatted"])
                state[5] += 1
            yield _batch(out, types, names)
        if begun:
            yield _batch([close()], types, names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)
