"""CRC-32 of many byte spans at once from a position table.

CRC-32 is linear over bits up to a constant that depends on the length alone:
the CRC of a span is the XOR of what each byte adds, given its distance from
the span's end, and of the CRC of as many zero bytes. The table holds what
each of the 256 bytes adds at each distance below BLOCK; one
``bitwise_xor.reduceat`` joins the bytes of all spans. A longer span is cut
into blocks from its end; the blocks' values are folded in pairs, the left one
moved on by the right one's length in zero bytes.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 64


def _step(state: np.ndarray) -> np.ndarray:
    """The state after one more zero byte."""
    return (state >> np.uint32(8)) ^ _ONE[state & np.uint32(255)]


#: What a last byte adds.
_ONE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
TABLE = np.empty((BLOCK, 256), np.uint32)
TABLE[0] = _ONE
for _d in range(1, BLOCK):
    TABLE[_d] = _step(TABLE[_d - 1])
_FLAT = TABLE.ravel()
#: CRC of n zero bytes, for n up to BLOCK.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


class _Move:
    """States after ``length`` zero bytes, by tables of the state's four bytes."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def __call__(self, state: np.ndarray) -> np.ndarray:
        out = self.tables[0][state & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ self.tables[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def twice(self) -> _Move:
        return _Move(self(self.tables))


def _first_move() -> _Move:
    tables = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(BLOCK):
        tables = _step(tables)
    return _Move(tables)


_MOVES = [_first_move()]


def _move(level: int) -> _Move:
    """Moves by BLOCK << level bytes."""
    while len(_MOVES) <= level:
        _MOVES.append(_MOVES[-1].twice())
    return _MOVES[level]


def _added(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of what the bytes of each span add; lengths from 1 to BLOCK."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(first[-1] + lengths[-1]))
    distance = np.repeat(first + lengths - 1, lengths) - at
    at += np.repeat(starts - first, lengths)
    return np.bitwise_xor.reduceat(_FLAT[(distance << 8) | data[at]], first)


def _long(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC of spans longer than BLOCK that have the same number of blocks."""
    n = -(-int(lengths[0]) // BLOCK)
    stops = (starts + lengths)[:, None] - BLOCK * np.arange(n - 1, -1, -1)[None, :]
    begins = np.maximum(stops - BLOCK, starts[:, None])
    values = _added(data, begins.ravel(), (stops - begins).ravel()).reshape(len(starts), n)
    level = 0
    while values.shape[1] > 1:
        if values.shape[1] % 2:  # a block of zero bytes in front adds nothing
            values = np.concatenate([np.zeros((len(values), 1), np.uint32), values], axis=1)
        values = _move(level)(values[:, 0::2]) ^ values[:, 1::2]
        level += 1
    own, which = np.unique(lengths, return_inverse=True)
    return values[:, 0] ^ np.array([zlib.crc32(bytes(int(x))) for x in own], np.uint32)[which]


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span ``data[start:start + length]``; spans may
    overlap and be of any length from 1 on."""
    long = lengths > BLOCK
    if not long.any():
        return _added(data, starts, lengths) ^ ZEROS[lengths]
    out = np.empty(len(starts), np.uint32)
    out[~long] = _added(data, starts[~long], lengths[~long]) ^ ZEROS[lengths[~long]]
    where, blocks = np.flatnonzero(long), -(-lengths[long] // BLOCK)
    for n in np.unique(blocks):
        own = where[blocks == n]
        out[own] = _long(data, starts[own], lengths[own])
    return out
