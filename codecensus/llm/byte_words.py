"""Words of Arrow string columns as byte spans, found with numpy.

Texts are read as UTF-8 bytes. A word is a maximal run of bytes of one class;
as the classes hold every byte of 0x80 and up, a run never cuts a character.
Texts are worked through in pieces of bounded size: many short texts, or a
part of a long one that ends between two words (a single longer word stays
whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21  # bytes

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_codes = np.arange(256)
LETTERS = (_codes >= 0x80) | ((_codes | 32) >= ord("a")) & ((_codes | 32) <= ord("z"))
LETTERS_DIGITS = LETTERS | (_codes >= ord("0")) & (_codes <= ord("9"))


@dataclass
class Piece:
    """Lower-cased bytes of the rows ``first`` to ``first + len(per) - 2`` and
    the spans of their words; row k has the words ``per[k]`` to ``per[k+1]``.
    The first ``repeated`` words stood in the piece before (same row).
    ``ends`` tells whether the last row ends here."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    per: np.ndarray
    repeated: int = 0
    ends: bool = True

    @property
    def owner(self) -> np.ndarray:
        """Row of each word."""
        return self.first + np.repeat(np.arange(len(self.per) - 1), np.diff(self.per))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes of the class ``inside``;
    none crosses a bound."""
    m = inside[data]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    before[bounds[bounds < len(m)]] = False
    after[bounds[bounds > 0] - 1] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def _word_end(data: np.ndarray, at: int, end: int, inside: np.ndarray, size: int) -> int:
    """First place from ``at`` on where no word goes on."""
    while at < end:
        gap = np.flatnonzero(~inside[data[at:min(at + size, end)]])
        if len(gap):
            return at + int(gap[0])
        at = min(at + size, end)
    return end


def pieces(column: pa.Array, inside: np.ndarray, back: int = 0, size: int = PIECE) -> Iterator[Piece]:
    """All rows in order. Pieces of a long text repeat the last ``back``
    words of the piece before."""
    offsets, data = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1, n)
        if j > i:
            own, bounds = LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i]
            starts, stops = spans(own, bounds, inside)
            yield Piece(i, own, starts, stops, np.searchsorted(starts, bounds))
            i = j
            continue
        at, end, repeated = int(offsets[i]), int(offsets[i + 1]), 0
        fresh = at
        while fresh < end:
            stop = _word_end(data, min(fresh + size, end), end, inside, size)
            own = LOWER[data[at:stop]]
            starts, stops = spans(own, np.array([0, len(own)]), inside)
            yield Piece(i, own, starts, stops, np.array([0, len(starts)]), repeated, stop == end)
            repeated = min(back, len(starts))
            at, fresh = at + int(starts[-repeated]) if repeated else stop, stop
        i += 1
