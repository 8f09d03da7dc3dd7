"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship


@dataclass(frozen=True)
class Template:
    """How a turn is written: open, role, role_end, text, close. open and close begin with `guard`.

    `moves` are the machine's transitions: from "" (the start) and each role to the roles that may
    follow; `final` are the roles a conversation may end with. `learned` roles have their text under
    the loss mask.
    """

    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    guard: tuple[str, str] = ("<", "|")
    learned: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        if not (self.open.startswith("".join(self.guard)) and self.close.startswith("".join(self.guard))):
            raise ValueError("open and close must begin with the guard")

    def escape(self, text: str) -> str:
        """A backslash goes between the guard's halves, also where backslashes stand there already."""
        a, b = map(re.escape, self.guard)
        return re.sub(rf"{a}(\\*){b}", lambda m: f"{self.guard[0]}\\{m[1]}{self.guard[1]}", text)

    def unescape(self, text: str) -> str:
        a, b = map(re.escape, self.guard)
        return re.sub(rf"{a}\\(\\*){b}", lambda m: f"{self.guard[0]}{m[1]}{self.guard[1]}", text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The text segments of one turn, each with its loss flag."""
        head = f"{self.open}{self.escape_role(role)}{self.role_end}"
        return [(head, False), (self.escape(text), role in self.learned), (self.close, False)]

    def turns(self, pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """Reads role, text and the text under the loss mask back from formatted segments.

        Only the written characters and the mask are used; one turn is held at a time.
        """
        text, mask = "", []
        for piece, loss in pieces:
            if loss:
                mask.append((len(text), len(text) + len(piece)))
            text += piece
            while (end := text.find(self.close)) >= 0:
                if not text.startswith(self.open):
                    raise ValueError("a turn does not begin with its marker")
                role, _, body = text[len(self.open) : end].partition(self.role_end)
                learned = "".join(text[a:b] for a, b in mask)
                yield self.unescape_role(role), self.unescape(body), self.unescape(learned)
                text, mask = text[end + len(self.close) :], []
        if text:
            raise ValueError("the last turn is not closed")


SEGMENTS = "conv_id long, turn_no long, segment_no int, role string, segment string, loss boolean, allowed boolean, last boolean"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The text segments of every conversation, in order within each partition.

    Turns go by turn (null first), ties by role and text; repeated rows are turns of their own. Null
    role or text is empty. `allowed` tells whether the machine permits the turn after the one before
    it (and, at the last turn, as an end); no turn is dropped for it. A conversation lies in one
    partition, sorted; a task streams it and holds one turn at a time, whatever its length. An empty
    table gives no rows; other columns are ignored.
    """
    ship(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()), ("role", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("allowed", pa.bool_()), ("last", pa.bool_())]
        )
        out: list[tuple] = []
        held = None  # the turn before, written once it is known whether it is the last

        def write(last: bool) -> None:
            conv, number, role, body, allowed = held
            allowed = allowed and (not last or role in template.final)
            for k, (piece, loss) in enumerate(template.segments(role, body)):
                out.append((conv, number, k, role, piece, loss, allowed, last))

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema)
            out.clear()
            return made

        for b in batches:
            for conv, role, body in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    write(not same)
                state, number = (held[2], held[1] + 1) if same else ("", 0)
                held = (conv, number, role, body, role in template.moves.get(state, ()))
            if out:
                yield batch()
        if held is not None:
            write(True)
            yield batch()

    return dealt.mapInArrow(formatted, SEGMENTS)


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What reading the segments back gives, per conversation; takes format_chats' partitions as they are.

    SHA-256 is a chain over a conversation's characters, so one task streams each; it keeps two hash
    states and one turn.
    """

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
        )
        turn: list[tuple[str, bool]] = []
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
        state = fresh()
        for b in batches:
            columns = (b.column(n).to_pylist() for n in ("conv_id", "segment_no", "segment", "loss", "allowed", "last"))
            for conv, k, piece, loss, allowed, last in zip(*columns, strict=True):
                turn.append((piece, loss))
                state[4] += len(piece)
                if k != 2:
                    continue
                for role, text, learned in template.turns(iter(turn)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                turn = []
                state[5] &= allowed
                if last:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    state = fresh()
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema)
                out = []

    return segments.mapInArrow(read_back, DIGEST)
