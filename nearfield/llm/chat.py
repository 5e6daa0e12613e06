"""Chat formatting by a finite-state machine over roles and a declarative template.

`format_conversations` emits text segments in order: the opening mark of a turn, its escaped text and the closing
mark, each with a flag that says whether the loss counts it. The machine says of every turn whether its role may
follow the one before; all turns are formatted, and a conversation with a forbidden step is marked from there on.

Escaping is reversible. A backslash is doubled, and in each control string of the template a backslash goes after
the first character, so that a text never holds a control string and the output splits at the marks alone.

A conversation is streamed in turn order through one task with constant state, whatever its length; nothing of it
is gathered but the rows in flight. Segments of a conversation stand together and in order in the output.

Edge cases: null text and null role are empty; unknown roles are written as they are after a mark of their own and
are always forbidden steps; rows of one turn that tie are ordered by role and text; repeated rows are turns;
conversations with a null id form one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, seq long, turn_no long, role string, part string, segment string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    open_before: str = "### "
    open_after: str = ": "
    close: str = "</turn>\n"
    #: What marks the end of a turn inside `close`; texts must not hold it.
    control: tuple[str, ...] = ("### ", "</turn>")
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    #: Stands before the name of a role that has none in `names`.
    other: str = "?"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: The machine: which roles may follow which; "" is the start.
    steps: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.control:
            text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def opening(self, role: str) -> str:
        name = self.names.get(role)
        name = name if name is not None else self.other + self.escape(role).replace(":", "\\:")
        return f"{self.open_before}{name}{self.open_after}"

    def role_of(self, opening: str) -> str:
        name = opening[len(self.open_before) : -len(self.open_after)]
        if name.startswith(self.other):
            return self.unescape(name[len(self.other) :])
        return {v: k for k, v in self.names.items()}[name]


def machine(roles: Iterator[str], template: Template) -> Iterator[bool]:
    """For each role whether the conversation is still in order after it."""
    state, good = "", True
    for role in roles:
        good = good and role in template.steps.get(state, ())
        state = role
        yield good


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """The segments of rows (conv_id, turn, role, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, good, turn_no, seq = object(), "", True, 0, 0
        for batch in parts:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current:
                    current, state, good, turn_no, seq = conv, "", True, 0, 0
                good = good and role in template.steps.get(state, ())
                state = role
                for part, segment, loss in (
                    ("open", template.opening(role), False),
                    ("text", template.escape(text), role in template.loss_roles),
                    ("close", template.close, False),
                ):
                    out.append((conv, seq, turn_no, role, part, segment, loss, good))
                    seq += 1
                turn_no += 1
            if out:
                kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.bool_()] * 2
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SEGMENTS.split(", ")])

    ordered = (
        rows.select(
            F.col("conv_id").cast("long"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, SEGMENTS)


class Reader:
    """Reads formatted text back as it arrives: turns, texts and the text under the loss, with constant state."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.first_bad, self.buffer, self.flags = -1, "", []

    def take(self, segment: str, loss: bool, valid: bool) -> None:
        self.formatted_chars += len(segment)
        if not valid and self.first_bad < 0:
            self.first_bad = self.n_turns
        if loss:
            plain = self.template.unescape(segment)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        self.buffer += segment
        while (end := self.buffer.find(self.template.close)) >= 0:
            turn, self.buffer = self.buffer[:end], self.buffer[end + len(self.template.close) :]
            head = turn.index(self.template.open_after) + len(self.template.open_after)
            role, text = self.template.role_of(turn[:head]), self.template.unescape(turn[head:])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1


def digest(segments: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row for each conversation, read back from the segments; they must come straight from the formatter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None
        names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars first_bad_turn".split()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def row(conv: int | None, r: Reader) -> tuple:
            return conv, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars, r.first_bad

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for batch in parts:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid"))
            for conv, segment, loss, valid in zip(*columns, strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(row(current, reader))
                    current, reader = conv, Reader(template)
                reader.take(segment, loss, valid)
            if done:
                yield packed(done)
        if reader is not None:
            yield packed([row(current, reader)])

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, first_bad_turn long"
    )
    return segments.select("conv_id", "segment", "loss", "valid").mapInArrow(run, schema)
