"""Vectorised numpy work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.Generator(np.random.PCG64(20240609)).integers(0, 2**63, 2, dtype=np.uint64)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = _tables[name] = np.multiply.accumulate(steps)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of at most 65,536 whole rows with about `most` bytes of text; a longer row comes alone."""
    _, offs = texts(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, lo + (1 << 16))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Spans:
    """Prefix sums that give a 64-bit key of any span of a code sequence.

    A polynomial modulo 2**64: equal spans have equal keys, but crafted spans can share one without being equal. It serves
    for candidate keys alone, whose pairs are compared by their text afterwards; what decides is `kinds` or `hashed`.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _powers("up", _BASE, n), out=self.sums[1:])
        self.down = _powers("down", pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _CODE[raw]


def kinds(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of spans in order and apart from each other: the number of each one's string, and these strings, compared byte by byte."""
    size = end - start
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    edge = np.bincount(start, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
    data = raw[np.cumsum(edge)[: len(raw)] > 0]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Seeded 128-bit hashes of spans as two independent halves (shape: 2, spans).

    Eight bytes after eight are mixed into a state that each step permutes, so nothing cancels out over a span.
    """
    size = end - start
    data = np.ascontiguousarray(np.r_[raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", data, 0, (1,))  # the eight bytes from each byte on
    out = np.stack([_SEEDS[i] ^ (size.astype(np.uint64) * np.uint64(_BASE)) for i in range(2)])
    left = np.flatnonzero(size > 0)
    at = 0
    while len(left):
        word = eight[start[left] + at]
        rest = size[left] - at
        short = rest < 8
        word[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        for i in range(2):
            h = (out[i, left] ^ word) * _STEPS[i]
            out[i, left] = h ^ (h >> np.uint64(32 - 3 * i))
        at += 8
        left = left[rest > 8]
    return np.stack([mix(out[0]), mix(out[1])])


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than 0x20 and 0x09-0x0D."""
    n = len(raw)
    ink = ~SPACE[raw]
    first, last = ink.copy(), ink.copy()
    if n:
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        full = offs[1:] > offs[:-1]
        heads, tails = offs[:-1][full], offs[1:][full] - 1
        first[heads] = ink[heads]
        last[tails] = ink[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of `values` over each row's span."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's items in an array ordered by row."""
    return np.searchsorted(row, np.arange(rows + 1), "left")


def chain(codes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` codes that begin at `start`, one code mixed in after the other."""
    out = np.full(len(start), size, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(size):
        out = mix((out ^ codes[start + i]) * np.uint64(_BASE))
    return out


def shingles(codes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of k codes inside a row, and their rows, ordered by row; a shorter row gives its whole sequence once.

    `codes` may be of shape (n,) or (hashes, n), for hashes of as many independent codes.
    """
    n = codes.shape[-1]
    bounds = row_bounds(row, rows)
    size = np.diff(bounds)
    left = np.arange(n, dtype=np.int64)
    start = [left[left + k <= bounds[1:][row]] if n else left]
    out = [np.stack([chain(c, start[0], k) for c in np.atleast_2d(codes)])]
    for short in range(1, k):
        start.append(bounds[:-1][size == short])
        out.append(np.stack([chain(c, start[-1], short) for c in np.atleast_2d(codes)]))
    of = row[np.concatenate(start)] if n else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    every = np.concatenate(out, axis=1)[:, order]
    return (every[0] if codes.ndim == 1 else every), of[order]


def distinct(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct codes, ordered by row and code."""
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], row[new]
