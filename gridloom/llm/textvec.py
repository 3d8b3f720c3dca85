"""Vectorised text kernels on Arrow string buffers: words, hashes, shapes, shingles.

Everything works on the raw UTF-8 bytes of a slice of rows at once, so the cost per
word is a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 19  # a slice of rows holds about this many bytes; one longer text makes a slice of its own

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, U64), np.ones(1, U64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, 0 to n-1 at least."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64 bits, in place on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG = 512  # bytes of a string that are hashed side by side with others


def string_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] of bytes: 8 bytes at a time are mixed in, so no two strings collide by their form.

    Strings over _LONG bytes are few; a hash of their own stands for the rest of them.
    """
    v = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    length = end - start
    h = mix(v[start] & _MASK[np.minimum(length, 8)] ^ length.astype(U64) * U64(0xD6E8FEB86659FD93))
    rest, k = np.flatnonzero(length > 8), 8
    while len(rest) and k < _LONG:
        h[rest] = mix(h[rest] * U64(0xD1342543DE82EF95) + (v[start[rest] + k] & _MASK[np.minimum(length[rest] - k, 8)]))
        k += 8
        rest = rest[length[rest] > k]
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """C with C[j]-C[i] = sum of values[i:j] times powers; n+1 entries."""
    c = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(len(values) + 1)[0][: len(values)], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever it stands; mixed, lengths included."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: ASCII punctuation separates words too
LOOSE = SPACE.copy()
LOOSE[:48] = LOOSE[58:65] = LOOSE[91:97] = LOOSE[123:128] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some rows, A-Z lower-cased.

    h: word hashes, on demand; row pointers: words ptr[r]:ptr[r+1] belong to row r;
    start, end: byte positions in ``low``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        """space: for each byte value whether it separates words."""
        base = int(offsets[0])
        self.low = _LOWER[data[base : int(offsets[-1])]]
        self.raw = data[base : int(offsets[-1])]
        self.off = offsets - base
        word = ~space[self.low]
        n = len(word)
        first = np.zeros(n + 1, bool)
        first[1:n] = word[1:] & ~word[:-1]
        last = np.zeros(n + 1, bool)
        last[1:n] = ~word[1:] & word[:-1]
        if n:
            first[0] = word[0]
            last[n] = word[n - 1]
            inner = self.off[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            first[inner] = word[inner]
            last[inner] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.ptr = np.searchsorted(self.start, self.off)

    @cached_property
    def h(self) -> np.ndarray:
        return string_hash(self.low, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, row pointers) of the n-word shingles, repeats included; a shorter row is one shingle, an empty one none."""
        h, cnt = self.h, self.counts
        if len(h) >= n:
            s = h[: len(h) - n + 1].copy()
            for j in range(1, n):
                s = s * U64(0xD1342543DE82EF95) + h[j : len(h) - n + 1 + j]
            s = mix(s)
        else:
            s = np.zeros(0, U64)
        m = np.where(cnt >= n, cnt - n + 1, (cnt > 0).astype(cnt.dtype))
        ptr = np.concatenate([[0], np.cumsum(m)])
        out = np.empty(int(ptr[-1]), U64)
        full = np.flatnonzero(cnt >= n)
        if len(full):
            src = np.repeat(self.ptr[full] - ptr[full], m[full])
            dst = np.repeat(ptr[full], m[full]) + _ramp(m[full])
            out[dst] = s[src + dst]
        for r in np.flatnonzero((cnt > 0) & (cnt < n)):
            x = 0xA24BAED4963EE407 + int(cnt[r])
            for w in h[self.ptr[r] : self.ptr[r + 1]].tolist():
                x = (x * 0xD1342543DE82EF95 + w) & 0xFFFFFFFFFFFFFFFF
            out[ptr[r]] = mix(np.array([x], U64))[0]
        return out, ptr

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: letters, capitals and digits collapsed to one mark each, other signs kept, runs collapsed."""
        kind = _SHAPE[self.raw]
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[self.start] = True
        rank = np.concatenate([[0], np.cumsum(keep)])
        return string_hash(kind[keep], rank[self.start], rank[self.end])


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, joined."""
    total = int(lengths.sum())
    out = np.arange(total)
    out -= np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out


ramp = _ramp


def row_sets(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, joined, with new row pointers."""
    parts, sizes = [], np.zeros(len(ptr) - 1, np.int64)
    for r in range(len(ptr) - 1):
        a, b = ptr[r], ptr[r + 1]
        if b > a:
            u = np.sort(values[a:b])
            if b - a > 1:
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
            parts.append(u)
            sizes[r] = len(u)
    return (np.concatenate(parts) if parts else np.zeros(0, values.dtype)), np.concatenate([[0], np.cumsum(sizes)])


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    c = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return c[ptr[1:]] - c[ptr[:-1]]


def row_mins(values: np.ndarray, ptr: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(ptr) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        out[full] = np.minimum.reduceat(values, ptr[full])
    return out


def blobs(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Each row's slice of a fixed-width array as a binary value."""
    raw = np.ascontiguousarray(values)
    off = (np.asarray(ptr, np.int64) * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw)]).cast(pa.binary())


class Lookup:
    """Positions of keys in a sorted table, by slots of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, n = keys, len(keys)
        bits = max(4, n.bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift), n).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it isn't there."""
        out = np.full(len(keys), np.int64(-1))
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit & (at[left] < end[left])]
        return out
