"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns.  Running sums of the turns' tokens decide
where a window ends and how many of the turns before it are repeated; the system turn is
kept in every window.  The loss mask covers each assistant text once: repeated targets are
masked.  Sorted partitions are streamed, so a conversation of any length needs the memory
of one window and its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: <turn ROLE>TEXT</turn> and a line end.  Inside, these characters are escaped
# with a backslash, so no text can look like a marker.
_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_INSIDE = r"[^\\<>]*(?:\\.[^\\<>]*)*"
_TURN = re.compile(rf"<turn ({_INSIDE})>({_INSIDE})</turn>\n", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Params:
    """At most `budget` tokens a window (words, and `marks` for each turn's markers), of which
    at most `history` are repeated turns.  A longer turn has a window of its own."""

    budget: int = 512
    history: int = 128
    marks: int = 2
    system: str = "system"
    target: str = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Window:
    """The turns of a conversation as they come; running token sums make the cuts."""

    def __init__(self, params: Params):
        self.params = params
        self.number = 0
        self.system: tuple | None = None
        self.history: list[tuple] = []
        self.fresh: list[tuple] = []
        self.sum = 0  # tokens of all turns so far but the system turn

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = sum(1 for _ in _WORD.finditer(text)) + self.params.marks
        turn = (role, text, self.sum, self.sum + size)
        if not self.fresh and self.system is None and self.number == 0 and role == self.params.system:
            self.system = turn
            return
        self.sum += size
        lead = self.system[3] if self.system else 0
        if self.fresh and lead + self.sum - self._begin() > self.params.budget:
            yield self.cut()
            seen = self.history + self.fresh
            self.history = [t for t in seen if turn[2] - t[2] <= self.params.history]
            self.fresh = []
        if not self.fresh and lead + self.sum - (self.history[0][2] if self.history else turn[2]) > self.params.budget:
            self.history = []
        self.fresh.append(turn)

    def _begin(self) -> int:
        return (self.history or self.fresh)[0][2]

    def cut(self) -> tuple:
        """(number, text, loss spans, repeated turns, tokens) of the window so far."""
        lead = [self.system] if self.system else []
        turns = [*lead, *self.history, *self.fresh]
        repeated = len(self.history) + (len(lead) if self.number else 0)
        parts, spans, at = [], [], 0
        for i, (role, text, _, _) in enumerate(turns):
            head, body = f"<turn {escape(role)}>", escape(text)
            if role == self.params.target and i >= repeated:
                spans.append({"begin": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, "</turn>\n"]
            at += len(head) + len(body) + 8
        tokens = (self.system[3] if lead else 0) + (self.fresh[-1][3] - self._begin() if self.fresh else 0)
        self.number += 1
        return self.number - 1, "".join(parts), spans, repeated, tokens


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_WINDOWS = "conv_id long, window long, text string, loss array<struct<begin:long,end:long>>, repeated long, tokens long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), _SPANS, pa.int64(), pa.int64())
    names = ["conv_id", "window", "text", "loss", "repeated", "tokens"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _former(params: Params):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Window | None = None
        conversation = None
        rows, held = [], 0
        for batch in batches:
            ids, roles, texts = (batch.column(c) for c in ("conv_id", "role", "text"))
            for i in range(batch.num_rows):
                conv = ids[i].as_py()
                if current is None or conv != conversation:
                    if current is not None:
                        rows.append((conversation, *current.cut()))
                    current, conversation = _Window(params), conv
                for cut in current.add(roles[i].as_py(), texts[i].as_py()):
                    rows.append((conversation, *cut))
                    held += len(cut[1])
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if current is not None:
            rows.append((conversation, *current.cut()))
        yield _batch(rows)

    return form


def format_chats(turns: DataFrame, params: Params = Params()) -> DataFrame:
    """Windows: conv_id, window (0, 1, ...), text, loss (spans of code points in text),
    repeated (how many leading turns were in an earlier window), tokens.

    Turns go by `turn` (null first); equal turn numbers go by role and text, and repeated rows
    are turns of their own.  A null text or role is empty.  Rows without conv_id are one
    conversation.  A first turn of the system role is kept in all windows; later ones are
    ordinary turns.  Other columns are ignored.
    """
    chosen = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_former(params), _WINDOWS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    names = [c.split()[0] for c in _READ.split(", ")]

    def done(last: list) -> list:
        return [last[0], last[1], last[2].hexdigest(), last[3], last[4].hexdigest(), last[5]]

    def out(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            conv = batch.column("conv_id")[i].as_py()
            if not rows or rows[-1][0] != conv:
                if len(rows) > 1000:
                    yield out([done(r) for r in rows[:-1]])
                    rows = rows[-1:]
                rows.append([conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
            own, text = rows[-1], batch.column("text")[i].as_py()
            repeated = batch.column("repeated")[i].as_py()
            at = 0
            for number, turn in enumerate(_TURN.finditer(text)):
                if turn.start() != at:
                    raise ValueError(f"conversation {conv}: text outside of turns")
                at = turn.end()
                if number >= repeated:
                    own[1] += 1
                    own[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            if at != len(text):
                raise ValueError(f"conversation {conv}: text outside of turns")
            for span in batch.column("loss")[i].as_py():
                target = unescape(text[span["begin"] : span["end"]])
                own[3] += len(target)
                own[4].update(target.encode())
            own[5] += len(text)
    yield out([done(r) for r in rows])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: the turns and the loss text, as digests."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_read, _READ)
