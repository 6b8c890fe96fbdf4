"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

A template says for each role what stands before and after a turn's text and which of the three parts bear loss. In texts a backslash
goes before every backslash and before every place where one of the template's control strings begins, so a control string of the
output is always the template's own and the output reads back to the very turns.

Conversations are sorted within partitions and streamed: a task holds one turn at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow

ESCAPE = "\\"


@dataclass(frozen=True)
class Part:
    """How turns of one role are written: before + text + after; loss flags of the three."""

    before: str
    after: str
    loss: tuple[bool, bool, bool] = (False, False, False)


@dataclass(frozen=True)
class Template:
    """roles: role -> part; other: the part of roles without one, whose ``{role}`` is the escaped role; moves: state -> role -> next state.

    The machine starts in ``start``; a role without a move is an error and leaves the state as it is; the conversation must end in one of ``ends``.
    """

    roles: dict[str, Part]
    other: Part
    moves: dict[str, dict[str, str]]
    start: str = "start"
    ends: frozenset[str] = field(default_factory=frozenset)

    def controls(self) -> list[str]:
        """Strings that have a meaning in the output: what begins a turn of any role, and what ends one."""
        parts = [*self.roles.values(), self.other]
        return sorted({p.before.split("{role}")[0] for p in parts} | {p.after for p in parts})

    def escape(self, text: str) -> str:
        return _escaper(tuple(self.controls())).sub(lambda m: ESCAPE + m[0], text)

    def escape_role(self, role: str) -> str:
        """As a text; also where what stands after the role in its opening begins."""
        return _escaper((*self.controls(), self.other.before.split("{role}")[1])).sub(lambda m: ESCAPE + m[0], role)

    def opening(self, role: str) -> str:
        return self.roles[role].before if role in self.roles else self.other.before.replace("{role}", self.escape_role(role))

    def part(self, role: str) -> Part:
        return self.roles.get(role, self.other)


_ESCAPERS: dict[tuple[str, ...], re.Pattern] = {}


def _escaper(controls: tuple[str, ...]) -> re.Pattern:
    if controls not in _ESCAPERS:
        if any(not c or ESCAPE in c for c in controls):
            raise ValueError("control strings must not be empty or hold a backslash")
        if any(c.startswith(c[-k:]) for c in controls for k in range(1, len(c))):
            raise ValueError("control strings must not begin with their own end: text before one could be read as a part of it")
        _ESCAPERS[controls] = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})" for c in controls))
    return _ESCAPERS[controls]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


#: User and assistant take turns, a system turn may come first, and the assistant's texts bear loss.
DEFAULT = Template(
    roles={
        "system": Part("### System: ", " </turn>\n"),
        "user": Part("### User: ", " </turn>\n"),
        "assistant": Part("### Assistant: ", " </turn>\n", (False, True, False)),
    },
    other=Part("### Other {role}: ", " </turn>\n"),
    moves={
        "start": {"system": "open", "user": "asked"},
        "open": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    ends=frozenset({"answered"}),
)

SEGMENTS = "conv_id bigint, turn bigint, segment bigint, text string, loss boolean, error string"


def segments(template: Template) -> Callable:
    """mapInArrow over rows sorted by conversation and turn: (conv_id, turn, role, text) -> SEGMENTS, three for each turn.

    error, in a turn's first segment, says why the machine refuses the turn; in the last segment of a conversation, that it may not end there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = _NONE
        state, number = template.start, 0
        last: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                role, text = role or "", text or ""
                if conv != current:
                    if last is not None:
                        out.append((*last[:5], _ending(template, state, last[5])))
                    last, current, state, number = None, conv, template.start, 0
                elif last is not None:
                    out.append(last)
                moved = template.moves.get(state, {}).get(role)
                error = None if moved else f"{role or 'no role'} after {state}"
                state = moved or state
                part = template.part(role)
                own = (template.opening(role), template.escape(text), part.after)
                rows = [(conv, turn, number + k, s, part.loss[k], error if k == 0 else None) for k, s in enumerate(own)]
                out += rows[:2]
                last, number = rows[2], number + 3
            yield _batch(out)
        if last is not None:
            yield _batch([(*last[:5], _ending(template, state, last[5]))])

    return run


_NONE = object()


def _ending(template: Template, state: str, error: str | None) -> str | None:
    return error if not template.ends or state in template.ends else f"ends after {state}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "segment", "text", "loss", "error"])


class Reader:
    """Reads turns back from formatted text that comes in pieces; holds one turn at a time."""

    def __init__(self, template: Template):
        self.template, self.held, self.loss = template, "", ""
        self.openings = sorted(((p.before, role) for role, p in template.roles.items()), key=lambda x: -len(x[0]))
        head, tail = template.other.before.split("{role}")
        self.other = re.compile(re.escape(head) + r"((?:[^\\]|\\.)*?)" + re.escape(tail), re.DOTALL)
        self.ends = {p.after: re.compile(r"((?:[^\\]|\\.)*?)" + re.escape(p.after), re.DOTALL) for p in [*template.roles.values(), template.other]}

    def turns(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that is complete with this piece."""
        self.held += piece
        while self.held:
            for before, role in self.openings:
                if self.held.startswith(before):
                    at = len(before)
                    break
            else:
                found = self.other.match(self.held)
                if not found:
                    return
                role, at = unescape(found[1]), found.end()
            text = self.ends[self.template.part(role).after].match(self.held, at)
            if not text:
                return
            self.held = self.held[text.end() :]
            yield role, unescape(text[1])


FACTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_errors bigint"


def read_back(template: Template) -> Callable:
    """mapInArrow over SEGMENTS in order -> FACTS, from the formatted text and the loss flags alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Facts | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in FACTS.split(", ")]
        for batch in batches:
            out = []
            for conv, text, loss, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "error")), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        out.append(state.row())
                    state = _Facts(template, conv)
                state.add(text, loss, error)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(state.row(), kinds, strict=True)], names)

    return run


class _Facts:
    def __init__(self, template: Template, conv: int | None):
        self.conv, self.reader = conv, Reader(template)
        self.turns, self.under = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.errors = 0

    def add(self, text: str, loss: bool, error: str | None) -> None:
        self.chars += len(text)
        self.errors += error is not None
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.under.update(plain.encode("utf-8", "surrogatepass"))
        for role, said in self.reader.turns(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.reader.held:
            raise ValueError(f"conversation {self.conv}: the formatted text ends within a turn")
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.under.hexdigest(), self.chars, self.errors)


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """SEGMENTS rows of all conversations, in order within each partition; a conversation's segments, concatenated, are its formatted text.

    Null texts and roles are empty; equal turn numbers are ordered by role, then text; null turns come first; null ids are one
    conversation; repeated rows are turns of their own; further columns are ignored. Refused turns are formatted all the same, with an error.
    """
    return map_arrow(_sorted(conversations), segments(template), SEGMENTS)


def chat_facts(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """FACTS rows: what the formatted conversations hold, read back from them."""
    return map_arrow(format_chat(conversations, template), read_back(template), FACTS)
