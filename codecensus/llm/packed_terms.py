"""Counting terms as packed numbers.

Terms are bytes without zeros. A term of up to 8 bytes becomes one uint64, of
up to 16 bytes two, with its first byte at the top and zeros behind, so equal
numbers are equal terms. Terms of a length bucket are sorted by a radix sort
of 16-bit digits, stable from the last digit to the first; the order of the
texts, which they come in, is kept inside a term. Then runs are counted. Longer
terms go to buckets of twice the width each, as rows of fixed width that are
sorted as bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: widest packed bucket, and its buckets in bytes
PACKED, WIDTHS = 16, (4, 8, 16)


@dataclass
class Runs:
    """Distinct (term, group) of one length bucket, or (term, document) of a
    part of a document: ``keys`` are uint64 columns, or one column of fixed
    width bytes."""

    keys: list[np.ndarray]
    lengths: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray


def width_of(lengths: np.ndarray) -> np.ndarray:
    """Bucket of each length: the least width that holds it."""
    widths = np.asarray(WIDTHS)
    out = np.full(len(lengths), 0, np.int64)
    short = lengths <= PACKED
    out[short] = widths[np.searchsorted(widths, lengths[short])]
    if not short.all():
        out[~short] = 1 << np.ceil(np.log2(lengths[~short])).astype(np.int64)
    return out


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> list[np.ndarray]:
    """Key columns of the spans, none longer than ``width``."""
    across = np.arange(width)
    at = starts[:, None] + across[None, :]
    inside = across[None, :] < lengths[:, None]
    rows = np.where(inside, data[np.where(inside, at, 0)], np.uint8(0))
    if width > PACKED:
        return [np.ascontiguousarray(rows).view(f"S{width}").ravel()]
    if width == 4:
        return [np.ascontiguousarray(rows).view(">u4").ravel().astype(np.uint64) << np.uint64(32)]
    whole = np.ascontiguousarray(rows).view(">u8").reshape(len(starts), -1)
    return [whole[:, k].astype(np.uint64) for k in range(whole.shape[1])]


def radix_order(keys: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Order by the keys, then by group, then as given."""
    order = np.argsort(group, kind="stable") if group.max(initial=0) >= 1 << 16 else np.argsort(group.astype(np.uint16), kind="stable")
    for key in reversed(keys):
        if key.dtype.kind == "S":
            return order[np.argsort(key[order], kind="stable")]
        for shift in (0, 16, 32, 48):
            digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if digit.min(initial=0xFFFF) < digit.max(initial=0):
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_count(keys: list[np.ndarray], lengths: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray,
              doc: np.ndarray | None = None) -> Runs:
    """One row for each (term, group): sums of ``n``, and of ``docs``, or where
    ``doc`` is given the number of different ones, which must come in order."""
    order = radix_order(keys, group)
    keys, group = [k[order] for k in keys], group[order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    if doc is not None:
        doc = doc[order]
        docs = new.copy()
        docs[1:] |= doc[1:] != doc[:-1]
    else:
        docs = docs[order]
    first = np.flatnonzero(new)
    total = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Runs([k[first] for k in keys], lengths[order][first], group[first], total(n[order]), total(docs))


def merged(parts: list[Runs]) -> Runs:
    """Rows of the same bucket put together."""
    return run_count([np.concatenate(k) for k in zip(*(p.keys for p in parts), strict=True)],
                     *(np.concatenate([getattr(p, x) for p in parts]) for x in ("lengths", "group", "n", "docs")))


def strings(keys: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
    """The terms of packed keys."""
    if keys[0].dtype.kind == "S":
        rows = np.ascontiguousarray(keys[0]).view(np.uint8).reshape(len(lengths), -1)
    else:
        rows = np.stack(keys, axis=1).astype(">u8").view(np.uint8).reshape(len(lengths), -1)
    flat = rows[np.arange(rows.shape[1])[None, :] < lengths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)))
