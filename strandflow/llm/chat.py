"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template marks every turn; control strings inside texts are escaped so
that the output can be read back. Segments carry a loss flag: only the text of
the roles in ``loss_roles`` is under the loss mask, never a mark.

Defined results: null text or role is the empty string; turns of a
conversation are ordered by turn, role and text (null first), so ties and
repeated rows have one order; a conversation whose roles break the automaton
is still formatted, with ``valid`` false; an empty table gives no rows; extra
columns are ignored. Turns stream through a task in order, so a conversation
of any length needs the memory of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import base_columns


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, loss roles and the role automaton of one chat format."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    control: str = "<|"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    accept: frozenset[str] = frozenset({"user", "assistant"})
    moves: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def escaped(self, text: str) -> str:
        head, tail = self.control[:1], self.control[1:]
        return text.replace(self.escape, self.escape * 2).replace(self.control, head + self.escape + tail)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def step(self, state: str | None, role: str) -> str | None:
        return role if state is not None and role in self.moves.get(state, ()) else None

    def segments(self, role: str, text: str) -> Iterator[tuple[str, str, bool]]:
        yield "mark", self.turn + self.escaped(role) + self.text, False
        yield "text", self.escaped(text), role in self.loss_roles
        yield "mark", self.end, False


DEFAULT = ChatTemplate()
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("kind", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def format_conversations(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Segments in order: conv_id, seg, kind (mark or text), segment, loss, state.

    Concatenated, the segments of a conversation are its formatted text.
    ``state`` is the automaton's state after the turn, null from the first
    illegal role on. Rows of a conversation lie together, in order.
    """
    turns = base_columns(conversations, "conv_id", "turn", "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seg, begun = None, None, 0, False
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not begun or c != conv:
                    conv, state, seg, begun = c, template.start, 0, True
                state = template.step(state, role or "")
                for kind, s, loss in template.segments(role or "", text or ""):
                    out.append((c, seg, kind, s, loss, state))
                    seg += 1
            cols = list(zip(*out, strict=True)) or [[]] * len(SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, SEGMENTS, strict=True)], schema=SEGMENTS)

    return turns.mapInArrow(run, "conv_id long, seg long, kind string, segment string, loss boolean, state string")


class _Reader:
    """Reads one conversation's segments back, turn by turn."""

    def __init__(self, conv_id, template: ChatTemplate):
        self.conv_id, self.t = conv_id, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.open, self.state = "", template.start

    def take(self, segment: str, loss: bool, state: str | None) -> None:
        self.chars += len(segment)
        self.state = state
        if loss:
            text = self.t.unescaped(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.open += segment
        while (stop := self.open.find(self.t.end)) >= 0:
            body, self.open = self.open[:stop], self.open[stop + len(self.t.end) :]
            if not body.startswith(self.t.turn):
                raise ValueError("a turn does not begin with its mark")
            role, _, text = body[len(self.t.turn) :].partition(self.t.text)
            self.turns.update(f"{self.t.unescaped(role)}\n{self.t.unescaped(text)}\n".encode())
            self.n += 1

    def row(self) -> tuple:
        ok = self.state is not None and self.state in self.t.accept
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, ok


def read_back(segments: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row per conversation from format_conversations(): counts and digests of what parses out of it."""

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        for batch in batches:
            done = []
            for c, s, loss, state in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss", "state")), strict=True):
                if now is None or now.conv_id != c:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(c, template)
                now.take(s, loss, state)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    return segments.mapInArrow(run, DIGEST)
