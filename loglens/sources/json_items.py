"""JSON lists cut into their items while they are read."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

PIECE = 1 << 20


def items_of(pieces: Iterator[bytes], key: str | None = None) -> Iterator[str]:
    """The JSON items of a list, or the one value, as text; holds one item and a piece. With
    ``key`` those of this entry of one object (none, if it has no such entry); others are skipped."""
    decode = codecs.getincrementaldecoder("utf-8")().decode
    scan = json.JSONDecoder().scan_once
    blank = re.compile(r"[ \t\r\n]*").match
    text, at, done = "", 0, False

    def more() -> bool:
        nonlocal text, at, done
        for piece in pieces:
            text, at = text[at:] + decode(piece), 0
            return True
        if not done:
            decode(b"", True)
        done = True
        return False

    def next_char() -> str:
        nonlocal at
        while True:
            at = blank(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                return ""

    def value() -> str:
        nonlocal at
        next_char()
        while True:
            try:
                _, end = scan(text, at)
                # A number, or a word, may go on in the next piece (1.5e, then 10).
                if text[at] in '{["' or (end < len(text) and text[end] in " \t\r\n,]}") or not more():
                    out, at = text[at:end], end
                    return out
            except (StopIteration, json.JSONDecodeError) as error:
                size = len(text) - at
                # Read about as much again before the next try, so that a long item costs little.
                while more() and len(text) < 2 * size + PIECE:
                    pass
                if done and len(text) - at == size:
                    raise ValueError(f"no JSON value in the last {size} characters") from error

    def expect(mark: str) -> None:
        nonlocal at
        if next_char() != mark:
            raise ValueError(f"{mark} is missing")
        at += 1

    def items() -> Iterator[str]:
        """The items of the list that begins here; or the value."""
        nonlocal at
        if next_char() != "[":
            yield value()
            return
        at += 1
        if next_char() == "]":
            at += 1
            return
        while True:
            if next_char() == "]":
                raise ValueError("a list ends with a comma")
            yield value()
            if next_char() == "]":
                at += 1
                return
            expect(",")

    if key is None:
        yield from items()
    else:
        expect("{")
        if next_char() == "}":
            at += 1
        else:
            while True:
                if next_char() != '"':
                    raise ValueError("an entry has no name")
                name = json.loads(value())
                expect(":")
                if name != key:
                    value()
                elif next_char() == "n":
                    value()  # null
                else:
                    yield from items()
                if next_char() == "}":
                    at += 1
                    break
                expect(",")
    if next_char():
        raise ValueError("text behind the value")
