"""Runs of bytes inside the texts of a slice: where they are, their hashes,
and their bytes as one column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import BYTE_KEYS, mix64, powers


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of True; none crosses a text."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(inside) + 1, dtype=bool)  # a text begins here
    edge[offs] = True
    new = inside.copy()
    new[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(new)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_KEYS[data] * p[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges one after another, each followed by ``after``, and
    the offsets of the ranges in them."""
    size = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + len(after), out=offs[1:])
    out = np.empty(offs[-1], np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(offs[:-1], size) + step] = data[np.repeat(starts, size) + step]
    for i, b in enumerate(after):
        out[offs[1:] - len(after) + i] = b
    return out, offs


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges of UTF-8 text as a string column."""
    raw, offs = gather(data, starts, ends)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw))
