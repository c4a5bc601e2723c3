"""Word and window hashes of whole Arrow batches in numpy, without a loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_B1, _B2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, base), np.full(size, _U(pow(int(base), -1, 2**64)))
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _B1) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair of bounds; equal runs, equal hashes."""
    up, down = _pow(base, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Words:
    """The words [^ \\t-\\r]+ of some texts: byte bounds, the first word of each text, hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = data
        word = ~_SPACE[data]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges], after[edges - 1] = False, False
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = runs(_TABLE[_LOWER[data] if lower else data], self.start, self.end)


def char_shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` characters (UTF-8) within each text, and the index of each text's first one."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    char = np.searchsorted(start, bounds)
    n = np.diff(char)
    first = np.zeros(len(bounds), np.int64)
    np.cumsum(np.maximum(n - (width - 1), 0), out=first[1:])
    if len(start) < width:
        return np.zeros(0, _U), first
    ends = np.append(start, len(data))
    up, down = _pow(_B1, len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * up[:-1], out=total[1:])
    # as in runs(), for every run of width characters; then those within one text
    total, size = total[ends], (ends[width:] - ends[:-width]).astype(_U)
    every = mix((total[width:] - total[:-width]) * down[start[: len(start) - width + 1]] + size)
    inside = np.arange(width, len(start) + 1) <= np.repeat(char[1:], n)[: len(start) - width + 1]
    return every[inside], first


def table_of(data: np.ndarray) -> np.ndarray:
    """Random value of each byte, for runs."""
    return _TABLE[data]





def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number within it, first byte and byte after the last of each line that has text, without white space at its ends."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
    # texts and feeds in one order: a feed that ends a text is followed by that text's last, empty line, then by the next text
    first = np.searchsorted(feeds, bounds[:-1]) + np.arange(len(bounds) - 1)
    owner = np.zeros(len(starts), np.int64)
    np.add.at(owner, first[1:], 1)
    owner = np.cumsum(owner)
    ends = np.empty(len(starts), np.int64)
    last = np.append(first[1:], len(starts)) - 1
    ends[:-1] = starts[1:] - 1
    ends[last] = bounds[1:]
    text = np.flatnonzero(~_SPACE[data])
    i, j = np.searchsorted(text, starts), np.searchsorted(text, ends)
    has = j > i
    number = np.arange(len(starts)) - first[owner]
    return owner[has], number[has], text[i[has]], text[j[has] - 1] + 1


def raw(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte bounds of a column of texts without nulls."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte bounds of the rows) by about `size` bytes; a null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(text)).fill_null("").cast(pa.large_string())
    n = len(col)
    data, off = raw(col)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, bounds in chunks(batch, text):
        yield i, j, Words(data, bounds, lower)


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)
