"""Walking a stream frame by frame without parsing what is not asked for."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

from latticelake.errors import ParseError
from latticelake.functions import grammar

_CHUNK = 1 << 20


class Span(NamedTuple):
    """A frame's place and its raw parts; parts that were not wanted are None."""

    index: int
    offset: int
    line: int
    n_atoms: int
    head: bytes
    note: bytes | None
    block: bytes | None


class Lines:
    """Buffered lines of a stream, which can also skip or take many lines at once.

    Line ends are found once for each chunk, so that a step over any number of lines
    costs the same.
    """

    def __init__(self, stream: io.BufferedIOBase, at: int = 0):
        self.stream, self.buffer, self.pos, self.at, self.ended = stream, b"", 0, at, False
        self.ends: list[int] = []
        self.turn = 0  # the next of ``ends``

    def _more(self) -> bool:
        if self.ended:
            return False
        chunk = self.stream.read(_CHUNK)
        if not chunk:
            self.ended = True
            return False
        rest = self.buffer[self.pos :]
        found = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + len(rest)
        self.buffer, self.pos, self.ends, self.turn = rest + chunk, 0, found.tolist(), 0
        return True

    def _take(self, end: int, keep: bool = True) -> bytes:
        out = self.buffer[self.pos : end] if keep else b""
        self.at += end - self.pos
        self.pos = end
        return out

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the stream."""
        while self.turn >= len(self.ends):
            if not self._more():
                return self._take(len(self.buffer)) if self.pos < len(self.buffer) else None
        end = self.ends[self.turn]
        self.turn += 1
        return self._take(end + 1)[:-1]

    def many(self, n: int, keep: bool) -> bytes | None:
        """The next ``n`` lines, or as many as there are, as one block (None if not kept)."""
        out: list[bytes] = []
        while n:
            step = min(n, len(self.ends) - self.turn)
            if step:
                self.turn += step
                n -= step
                out.append(self._take(self.ends[self.turn - 1] + 1, keep))
            if n and not self._more():
                out.append(self._take(len(self.buffer), keep))
                break
        return b"".join(out) if keep else None


def walk(
    stream: io.BufferedIOBase,
    want: Callable[[int], bool] = lambda i: True,
    last: int | None = None,
    notes: bool = False,
    blocks: bool = True,
    index: int = 0,
    offset: int = 0,
    line: int = 1,
    limit: int | None = None,
) -> Iterator[Span]:
    """Frames in order, from a stream that stands at a count line.

    ``want`` selects frames whose parts are kept, ``last`` is the last index to reach,
    ``limit`` the number of frames; a blank line where a count is due ends the file.
    A count is trusted, so a lying one shows at the frame behind it.
    """
    lines = Lines(stream, offset)
    while (last is None or index <= last) and (limit is None or limit > 0):
        at = lines.at
        head = lines.line()
        if head is None or not head.strip():
            return
        n = grammar.count_at(head, index, line)
        note = lines.line()
        if note is None:
            raise ParseError("missing comment line", index, line + 1)
        wanted = want(index)
        block = lines.many(n, wanted and blocks)
        if wanted:
            yield Span(index, at, line, n, head, note if notes or blocks else None, block)
        index, line = index + 1, line + n + 2
        limit = None if limit is None else limit - 1
