"""Texts of an Arrow column as byte blocks, and the hashes of their words, without a Python loop per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is `[^\\x20\\x09-\\x0D]+`.
Words never cross the end of a text. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others on their executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """offsets[i]:offsets[i + 1] are the bytes of text i in data."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def utf8(column: pa.Array) -> Texts:
    """The bytes of a string column."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(0, off - off[0], raw[off[0] : off[-1]]) if len(column) else Texts(0, np.zeros(1, np.int64), raw[:0])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Consecutive texts of about limit bytes together; a longer text stands alone. Bounds the
    memory of what is derived from a block, whatever the batch size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    t = utf8(column)
    i, n = 0, len(t)
    while i < n:
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        off = t.offsets[i : j + 1]
        yield Texts(i, off - off[0], t.data[off[0] : off[-1]])
        i = j
    give_back()


@dataclass
class Words:
    """Bounds of each word, its 64-bit hash, and for text i the words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(t: Texts, lower: bool = False) -> Words:
    """All words of a block; lower folds A-Z only."""
    inside = ~_SPACE[t.data]
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offsets] = True
    before = np.zeros(len(t.data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(t.data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, t.offsets)
    return Words(starts, ends, span_hashes(t.data, starts, ends, _BYTE_LOWER if lower else _BYTE), first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from their values and places alone: the sum of value times power of the
    place, read off one running sum and shifted back to the start of the span."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # some text at a time
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _KEPT - 1, "right")))
        at = starts[i]
        power, inverse = _powers(int(ends[j - 1] - at) + 1)
        total = np.zeros(ends[j - 1] - at + 1, np.uint64)
        np.cumsum(table[data[at : ends[j - 1]]] * power[: len(total) - 1], out=total[1:])
        n = ends[i:j] - starts[i:j]
        out[i:j] = mix((total[ends[i:j] - at] - total[starts[i:j] - at]) * inverse[starts[i:j] - at] + n.astype(np.uint64) * _STEP)
        i = j
    return out


_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse; those up to _KEPT are kept."""
    return _kept_powers() if n <= _KEPT else (_power_row(_STEP, n), _power_row(_INVERSE, n))


_KEPT = (1 << 18) + 1


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_row(_STEP, _KEPT), _power_row(_INVERSE, _KEPT)


def _power_row(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the offsets of each text's shingles. A text of 1 to k - 1
    words has its whole sequence as its one shingle; a text without words has none."""
    count = np.diff(w.first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1], n) + np.arange(off[-1]) - np.repeat(off[:-1], n)
    left = np.repeat(count, n)
    padded = np.concatenate([w.hashes, np.zeros(k, np.uint64)])
    out = np.zeros(off[-1], np.uint64)
    for i in range(k):
        out = mix(out + np.where(left > i, padded[at + i], _U(i + 1)))
    return out, off


def parity(h: np.ndarray, off: np.ndarray, longs: int) -> list[np.ndarray]:
    """Parity sketches of runs of distinct values, none empty, as `longs` columns: two sets differ in at least as many values
    as their sketches differ in bits."""
    v = mix(h ^ _U(0x1B873593))
    bit, own = _U(1) << (v & _U(63)), (v >> _U(6)) & _U(longs - 1)
    return [np.bitwise_xor.reduceat(np.where(own == _U(j), bit, _U(0)), off[:-1]) if len(off) > 1 else np.zeros(0, np.uint64) for j in range(longs)]


def packed(x: np.ndarray, width: int, planes: bool = True) -> bytes:
    """The low `width` bytes of each value; in planes, byte by byte, so that equal high bytes lie together and compress."""
    x = np.ascontiguousarray(x)
    if width == x.dtype.itemsize and not planes:
        return x.tobytes()
    low = x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width]
    return (low.T if planes else low).tobytes()


def unpacked(data: bytes, size: int, width: int, kind: type, planes: bool = True) -> np.ndarray:
    """The values that packed() wrote."""
    if width == np.dtype(kind).itemsize and not planes:
        return np.frombuffer(data, kind)
    out = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    raw = np.frombuffer(data, np.uint8)
    out[:, :width] = raw.reshape(width, size).T if planes else raw.reshape(size, width)
    return out.view(kind)[:, 0]
