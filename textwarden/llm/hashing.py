"""Vectorised hashing of words and word windows, straight on the buffers of Arrow string columns.

Words are hashed as polynomials over random 64-bit values of their bytes, all rows of a slice at once. Slices hold about
a megabyte of text (a longer text is a slice of its own), which bounds the memory of a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) of x plus a seed's offset."""
    z = x + np.uint64((seed + 1) * _BASE & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, at least as long as a slice."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 4096:
            _powers[base] = got
    return got[:n]


@dataclass
class Words:
    """Words of the rows of one slice. row k has the words first[k] .. first[k + 1]; start and end are byte offsets in data."""

    row0: int
    data: np.ndarray
    row_start: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the size words from each word on, and whether these lie in one row."""
        n = len(self.code)
        out = np.zeros(n, dtype=np.uint64)
        ok = np.zeros(n, dtype=bool)
        if n < size:
            return out, ok
        acc = np.zeros(n - size + 1, dtype=np.uint64)
        for k, c in enumerate(_power(0xD1342543DE82EF95, size)):
            acc += self.code[k : n - size + 1 + k] * c
        out[: n - size + 1] = mix(acc, size)
        last = np.repeat(self.first[1:], np.diff(self.first))
        ok[:] = np.arange(n) + size <= last
        return out, ok


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in the spans (both ends in)."""
    table = np.zeros(256, dtype=bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED_VALUES = _BYTE_VALUES[_FOLD]


def raw_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets of the rows in them) of each slice of a string column; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_slices(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[Words]:
    """The words of each slice, with ASCII letters in lower case. separators: which bytes part words."""
    values = np.where(separators, np.uint64(0), _FOLDED_VALUES)
    for row, data, at in raw_slices(column):
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        edge = edge[:-1]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        start = np.flatnonzero(inside & (~before | edge))
        after = np.ones_like(inside)
        after[:-1] = ~inside[1:] | edge[1:]
        end = np.flatnonzero(inside & after) + 1
        first = np.searchsorted(start, at)
        if len(start):
            weighted = values[data] * _power(_BASE, len(data))
            code = mix(np.add.reduceat(weighted, start) * _power(_INVERSE, len(data))[start])
        else:
            code = np.zeros(0, dtype=np.uint64)
        yield Words(row, data, at, first, start, end, code)
