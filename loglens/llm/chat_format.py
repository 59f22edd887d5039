"""Chat formatting with a grammar round trip.

A conversation is written as turns ``<|im_start|>role\\ntext<|im_end|>\\n``. Every written
turn is parsed again by a deterministic parser, and what it recovers is compared with the
source. Content that does not come back the same (it holds a control string, or something
that reads as an escape) is escaped, and the turn is written and parsed again until both
are identical. Plain content is thus left as it is.

An escape puts a backslash between ``<`` and ``|`` (or one more where backslashes stand
there); in roles also ``\\`` and line ends are escaped. The loss mask covers the text of
the assistant's turns.

The turns of a conversation come to one task in order and are handled one at a time, so
a conversation of any length needs the memory of one turn.

Results for odd input: turns are in order of (turn, role, text), nulls first; null texts
and roles are empty; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURNS = "conv_id long, place long, formatted string, loss_start long, loss_end long"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class NotATurn(ValueError):
    """The text is not in the grammar."""


def parse(text: str, at: int = 0):
    """The turn that begins at a place: (role, text, where its text begins and ends, where
    the next turn begins). A role ends at the first line end, a text at the first END."""
    if not text.startswith(START, at):
        raise NotATurn(f"no turn begins at {at}")
    line = text.find("\n", at)
    body = line + 1
    stop = text.find(END, body)
    if line < 0 or stop < 0 or not text.startswith("\n", stop + len(END)):
        raise NotATurn(f"the turn at {at} does not end")
    role, content = text[at + len(START) : line], text[body:stop]
    if START in role or END in role or START in content:
        raise NotATurn(f"a control string inside the turn at {at}")
    return unescape_role(role), unescape(content), body, stop, stop + len(END) + 1


def parse_all(text: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(text):
        role, content, _, _, at = parse(text, at)
        turns.append((role, content))
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as far as its round trip asks for."""
    shown_role, shown = role, text
    steps = [(role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))]
    while True:
        out = f"{START}{shown_role}\n{shown}{END}\n"
        try:
            got_role, got, _, _, end = parse(out)
            whole = end == len(out)
        except NotATurn:
            got_role = got = None
            whole = False
        if whole and got_role == role and got == text:
            return out
        # Escape the text, or the role, or both: the first that comes back identical.
        shown_role, shown = steps.pop(0)


def _format(batches):
    conv, place, first = None, 0, True
    for batch in batches:
        rows = []
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if first or conv_id != conv:
                conv, place, first = conv_id, 0, False
            out = render(role or "", text or "")
            got_role, _, begin, end, _ = parse(out)
            loss = (begin, end) if got_role == ASSISTANT else (None, None)
            rows.append((conv_id, place, out, *loss))
            place += 1
        names = [x.split()[0] for x in TURNS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, place, formatted, loss_start, loss_end: the written turns, in order inside
    each partition, with the characters of each that the loss counts. The formatted
    conversation is its turns one after the other."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").cast("long")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, TURNS)


class _Reader:
    """Reads one conversation back from what was written."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, begin, end) -> None:
        self.chars += len(formatted)
        for role, text in parse_all(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            masked = unescape(formatted[begin:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self):
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches):
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    reader = None
    for batch in batches:
        rows = []
        for conv_id, _, *turn in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    rows.append(reader.row())
                reader = _Reader(conv_id)
            reader.take(*turn)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    if reader is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(reader.row(), types)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the masked text of each conversation, parsed from ``format_chat``."""
    return formatted.mapInArrow(_read_back, DIGEST)
