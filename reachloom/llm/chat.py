"""Chat formatting from a declarative template, with turn order checked by a finite-state machine.

A template is a dictionary: the strings that open and close a turn, the escape character, the roles whose text the
loss covers, and the machine (state -> role -> next state, the start state and the accepting states). Control strings
inside texts are escaped, so that a formatted conversation reads back to exactly its turns.

Rows of a conversation are taken by turn (ties by role, then text) and streamed in that order through one task, which
holds one slice of rows whatever the conversation's length.

Cases: a null text or role counts as empty. Rows with a null conv_id form one conversation; null turns come first. A
role the machine doesn't expect makes the conversation invalid and moves on from the start state; it is formatted all
the same. Repeated rows are turns of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT_TEMPLATE = {
    "open": "### ",
    "after_role": ": ",
    "close": " </turn>\n",
    "marks": ["###", "</turn>"],
    "escape": "\\",
    "loss": ["assistant"],
    "start": "start",
    "accept": ["answered"],
    "moves": {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
}

SLICE = 512


class Template:
    """Escaping, formatting and reading back by one template."""

    def __init__(self, spec: dict):
        self.spec, e = spec, re.escape(spec["escape"])
        marks = "|".join(map(re.escape, spec["marks"]))
        self.in_text = re.compile(f"(?={e}|{marks})")
        self.in_role = re.compile(f"(?={e}|{re.escape(spec['after_role'][0])}|{marks})")
        self.escaped = re.compile(f"{e}(.)", re.S)
        body, role = f"(?:{e}.|[^{e}])*?", f"(?:{e}.|[^{e}])*?"
        self.turn = re.compile(
            f"{re.escape(spec['open'])}({role}){re.escape(spec['after_role'])}({body}){re.escape(spec['close'])}", re.S
        )

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        put = lambda p, t: p.sub(lambda _: self.spec["escape"], t)
        return [
            (self.spec["open"] + put(self.in_role, role) + self.spec["after_role"], False),
            (put(self.in_text, text), role in self.spec["loss"]),
            (self.spec["close"], False),
        ]

    def plain(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)

    def next_state(self, state: str, role: str) -> tuple[str, bool]:
        moves = self.spec["moves"]
        if role in moves.get(state, {}):
            return moves[state][role], True
        return moves[self.spec["start"]].get(role, self.spec["start"]), False


def format_chat(
    turns: DataFrame,
    template: dict = CHAT_TEMPLATE,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Segments in order: conv_id, turn_no (from 1), segment (0 opens, 1 text, 2 closes), text, loss, state, in_order."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn_no bigint, segment int, text string, loss boolean, state string, in_order boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, conv_now, number, state = Template(template), object(), 0, ""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                convs = part.column(0)
                out: list[list] = [[] for _ in range(6)]
                take = []
                for k, (c, r, t) in enumerate(zip(convs.to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if number == 0 or c != conv_now:
                        conv_now, number, state = c, 0, template["start"]
                    number += 1
                    state, good = made.next_state(state, r)
                    for s, (piece, loss) in enumerate(made.segments(r, t)):
                        take.append(k)
                        for column, value in zip(out, (number, s, piece, loss, state, good), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [convs.take(pa.array(take, pa.int64())), *(pa.array(x, y) for x, y in zip(out, types, strict=True))],
                    names=["conv_id", "turn_no", "segment", "text", "loss", "state", "in_order"],
                )

    return rows.mapInArrow(run, schema)


class Reader:
    """Reads one conversation's segments back into turns, and digests what it reads."""

    def __init__(self, template: Template):
        self.template, self.held, self.loss_held = template, "", []
        self.turns, self.formatted, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        self.formatted += len(text)
        self.held += text
        if loss:
            self.loss_held.append(text)
        if not text.endswith(self.template.spec["close"][-1]):
            return
        while m := self.template.turn.match(self.held):
            self.held = self.held[m.end() :]
            self.turns += 1
            role, body = self.template.plain(m[1]), self.template.plain(m[2])
            self.all.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            learnt = self.template.plain("".join(self.loss_held))
            self.loss_held = []
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))


def read_back(segments: DataFrame, template: dict = CHAT_TEMPLATE) -> DataFrame:
    """One row for each conversation of format_chat()'s output, from the formatted text and the loss flags alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, reader, conv, valid, state, conv_type = Template(template), None, None, True, "", None

        def row():
            ok = valid and state in template["accept"]
            values = [reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted, ok]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], conv_type), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=names
            )

        done: list[pa.RecordBatch] = []
        for batch in batches:
            conv_type = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for c, n, s, text, loss, now, good in zip(*(part[x] for x in ("conv_id", "turn_no", "segment", "text", "loss", "state", "in_order")), strict=True):
                    if n == 1 and s == 0:
                        if reader:
                            done.append(row())
                        reader, conv, valid = Reader(made), c, True
                    reader.feed(text, loss)
                    valid, state = valid and good, now
                if done:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []
        if reader:
            yield row()

    return segments.mapInArrow(run, schema)
