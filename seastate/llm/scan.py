"""Byte-level text scanning in numpy, shared by the operators.

Texts arrive as Arrow string columns. They are taken in chunks of a few MB (a longer text is a chunk of its own), words are
found by a table over byte values, and every word or line gets a 64-bit rolling hash from one running sum over the bytes.
UTF-8 keeps every byte of a multi-byte character at 0x80 or above, so ASCII separators can be looked for bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_LOG, _BLOCK = 18, 1 << 18
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & _MASK, dtype=_U)
    p[0] = 1
    return np.cumprod(p)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags per byte value, set on the given inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


NON_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
NON_BREAK = ~table((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Chunk(NamedTuple):
    """Consecutive rows of one Arrow column: their bytes and where each row begins and ends."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.begin[i] : self.end[i]].tobytes().decode("utf-8")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in pieces of about ``limit`` bytes; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    begin, end = off[:-1], off[1:]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        lo = off[a]
        yield Chunk(a, data[lo : off[b]], begin[a:b] - lo, end[a:b] - lo)
        a = b


class Spans(NamedTuple):
    """Byte spans of words or lines in a chunk, with the row each lies in."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def spans(chunk: Chunk, data: np.ndarray, inside: np.ndarray) -> Spans:
    """Longest runs of bytes flagged in ``inside``; no run crosses a row."""
    m = np.zeros(len(data) + 2, dtype=bool)
    m[1:-1] = inside[data]
    prev, nxt = m[:-2].copy(), m[2:].copy()
    full = chunk.end > chunk.begin
    prev[chunk.begin[full]] = False
    nxt[chunk.end[full] - 1] = False
    start = np.flatnonzero(m[1:-1] & ~prev)
    end = np.flatnonzero(m[1:-1] & ~nxt) + 1
    return Spans(start, end, np.searchsorted(chunk.begin[full], start, side="right") - 1 if full.all()
                 else np.flatnonzero(full)[np.searchsorted(chunk.begin[full], start, side="right") - 1])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per span from running sums taken block by block; equal bytes, equal hash."""
    at_start, at_end = np.zeros(len(start), _U), np.zeros(len(end), _U)
    step, inv_step = pow(_BASE, _BLOCK, 1 << 64), pow(pow(_BASE, -1, 1 << 64), _BLOCK, 1 << 64)
    carry, mult, inv_mult = 0, 1, []
    for lo in range(0, len(data), _BLOCK):
        m = min(_BLOCK, len(data) - lo)
        c = np.zeros(m + 1, _U)
        np.cumsum(_BYTE_CODE[data[lo : lo + m]] * _POW[:m], out=c[1:])
        c = c * _U(mult) + _U(carry)
        a, b = np.searchsorted(start, [lo, lo + m])
        at_start[a:b] = c[start[a:b] - lo]
        a, b = np.searchsorted(end, [lo + 1, lo + m + 1])
        at_end[a:b] = c[end[a:b] - lo]
        inv_mult.append(inv_mult[-1] * inv_step & _MASK if inv_mult else 1)
        carry, mult = int(c[m]), mult * step & _MASK
    if not len(start):
        return at_start
    inv = _INV[start & (_BLOCK - 1)] * np.array(inv_mult, dtype=_U)[start >> _LOG]
    return mix((at_end - at_start) * inv + (end - start).astype(_U) * _U(0x9FB21C651E98DF25))


class WordSums:
    """Running sums over word hashes: the hash of any window of words is one subtraction."""

    def __init__(self, word_hash: np.ndarray):
        n = len(word_hash)
        self.n = n
        self.inv = _powers(pow(_WORD_BASE, -1, 1 << 64), max(n, 1))
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(word_hash * _powers(_WORD_BASE, max(n, 1))[:n], out=self.sums[1:])

    def windows(self, length: int, start: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of ``length`` words at ``start`` (default: all that fit)."""
        if start is None:
            start = np.arange(max(0, self.n - length + 1))
        h = (self.sums[start + length] - self.sums[start]) * self.inv[start]
        return mix(h + _U(length * 0x8CB92BA72F3D8DD7 & _MASK))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen twice or more, equal to an earlier one) for every key."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return twice, later
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    if not same.any():
        return twice, later
    grouped = np.zeros(n, bool)
    grouped[1:] |= same
    grouped[:-1] |= same
    idx = order[grouped]
    head = np.flatnonzero(np.r_[True, ~same][grouped])
    twice[idx] = True
    later[idx] = True
    later[np.minimum.reduceat(idx, head)] = False
    return twice, later


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the positions below ``n`` that lie in a window of ``length`` from any start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    stop = np.bincount(np.minimum(starts + length, n), minlength=n + 1).astype(np.int32)
    return np.cumsum(d - stop)[:n] > 0
