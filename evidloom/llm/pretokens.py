"""Cutting text into the pre-tokens of a byte-level BPE, with chunks between spaces cut once.

In a text without white space next to a space, the pre-tokens of each chunk between single spaces depend on that
chunk alone, with the space before it. So a task cuts every distinct chunk once; other texts go through the pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: A space with white space beside it, where chunks depend on each other.
MEETING = regex.compile(r" \s|\s ")


class Cutter:
    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.cut = self.pattern.findall

    def each(self, text: str) -> Iterator[str]:
        """The pre-tokens one by one, for texts whose list would be long."""
        return (m.group() for m in self.pattern.finditer(text))

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Strings that are cut each for itself (rare), and chunks to be cut with a space before them."""
        if MEETING.search(text):
            return [text], []
        first, *rest = text.split(" ")
        return [first] if first else [], rest


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out
