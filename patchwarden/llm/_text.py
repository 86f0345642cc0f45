"""Vectorised text kernels on Arrow string columns.

A column of texts is viewed as one UTF-8 byte buffer with document offsets. Words, lines and
their 64-bit hashes come from whole-buffer numpy passes, so the cost is a few nanoseconds a
byte and no Python object is made per word. Texts are never cut: a block holds whole documents,
and a document larger than the block size is a block of its own. Tables of powers have one block's size
whatever the texts' is: exponents start anew with each segment of a long text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 20
NO_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_pows: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to a segment."""
    if not _pows or len(_pows[0]) != SEGMENT + 1:
        _pows.clear()
        for b in (_BASE, _INV):
            p = np.full(SEGMENT + 1, b, np.uint64)
            p[0] = 1
            _pows.append(np.cumprod(p))
    return _pows


def byte_table(inside) -> np.ndarray:
    """A boolean for each byte value."""
    return np.array([bool(inside(b)) for b in range(256)])


def _space(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


#: words [^\x20\x09-\x0D]+
NOT_SPACE = byte_table(lambda b: not _space(b))
#: words of digits, a-z and everything outside ASCII
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: words of ASCII letters and everything outside ASCII
LETTERS = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    buf, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Spans:
    """Runs of word bytes, or lines, of a block: starts, ends and first run of each document."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, off: np.ndarray):
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, off)  # one more than documents
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> Spans:
    w = table[buf]
    if not len(w):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), off)
    edge = np.zeros(len(w) + 1, bool)
    edge[off] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:-1]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:-1]
    return Spans(np.flatnonzero(start), np.flatnonzero(end) + 1, off)


def lines(buf: np.ndarray, off: np.ndarray) -> Spans:
    """The \\n-split lines of each document; an empty text has one empty line, which is left out."""
    full = off[:-1] < off[1:]
    nl = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.concatenate([off[:-1][full], nl + 1]), kind="stable")
    ends = np.sort(np.concatenate([nl, off[1:][full]]), kind="stable")
    doc = np.repeat(np.arange(len(full)), full.astype(np.int64) + _inside(nl, off))
    out = Spans.__new__(Spans)
    out.starts, out.ends = starts, ends
    out.count = np.bincount(doc, minlength=len(full)).astype(np.int64)
    out.first = np.concatenate([[0], np.cumsum(out.count)])
    return out


def _inside(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(positions, off))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums from which any span's hash follows in O(1) a segment."""
    p, _ = _powers()
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    for i in range(0, len(buf), SEGMENT):
        part = buf[i : i + SEGMENT]
        out = s[i + 1 : i + 1 + len(part)]
        np.cumsum(_BYTE.take(part) * p[: len(part)], out=out)
        if i:
            out += s[i]
    return s


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes have equal hashes wherever they stand."""
    p, inv = _powers()
    if len(sums) <= SEGMENT + 1:
        h = (sums.take(ends) - sums.take(starts)) * inv.take(starts)
    else:
        into = starts % SEGMENT
        stop = starts - into + SEGMENT
        h = (sums[np.minimum(ends, stop)] - sums[starts]) * inv[into]
        row = np.flatnonzero(ends > stop)  # spans that go on in further segments
        at, end, power = stop[row], ends[row], p[(stop - starts)[row]]
        while len(row):
            to = np.minimum(end, at + SEGMENT)
            h[row] += (sums[to] - sums[at]) * power
            more = end > to
            row, at, end, power = row[more], to[more], end[more], power[more] * p[SEGMENT]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring spans."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k * 0xA0761D6478BD642F % (1 << 64), np.uint64)
    for i in range(k):
        out = out * np.uint64(0xE7037ED1A0B428DB) + h[i : i + n]
    return mix64(out)


def whole_hash(h: np.ndarray) -> np.ndarray:
    """window_hash of all of h, as an array of one."""
    return window_hash(h, len(h))


def code_points(buf: np.ndarray) -> np.ndarray:
    """True for the first byte of each code point."""
    return (buf & 0xC0) != 0x80


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and an executor
    has several."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Count of True bytes in each document."""
    s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return s[off[1:]] - s[off[:-1]]
