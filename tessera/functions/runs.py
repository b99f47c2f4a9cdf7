"""Hashes of runs of words, over whole blocks of texts at once."""

from __future__ import annotations

import functools

import numpy as np

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEPT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse."""
    rows = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        rows.append(np.multiply.accumulate(p))
    return rows[0], rows[1]


_kept_rows = functools.cache(lambda: _power_rows(_KEPT))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[off[i]:off[i + 1]], and the first word of each text. Words end at ASCII white space and with their text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    power, inverse = _kept_rows() if len(data) <= _KEPT else _power_rows(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(_STEP))
    return hashes, np.searchsorted(starts, off)


def run_sets(data: np.ndarray, off: np.ndarray, seeds: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of k words, scrambled by its seed; a shorter text is its one run, one without a word has none."""
    hashes, first = word_hashes(data, off)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    cut = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1], n) + np.arange(cut[-1]) - np.repeat(cut[:-1], n)
    left, padded, out = np.repeat(count, n), np.concatenate([hashes, np.zeros(k, np.uint64)]), np.repeat(seeds, n)
    for i in range(k):
        out = mix(out + np.where(left > i, padded[at + i], _U(i + 1)))
    return [np.unique(out[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
