"""Periodic runs: stretches of words that repeat three times or more in a row, and texts with the repeats cut off.

Words are runs of characters other than 0x20 and 0x09-0x0D, told apart by 64-bit hash. A run is a stretch with smallest period q
(words q apart are the same) and length >= max(least, 3 * q) that no neighbouring word extends keeping period q.

Seed and extend along diagonals, each text by itself:

1. A run of period q makes a match of at least max(least - q, 2 * q) words between the text and itself moved by q: the diagonal of lag q. No
   lag guarantees less than 2 / 3 of `least`; texts in which no gram of that length occurs twice have no run and are done.
2. Lags are taken in bands from lo to below 3 / 2 lo, with grams of the overlap that lo guarantees, K = 2 * lo words. Occurrences of one
   gram inside a run of period q lie more than K - q > K / 4 apart, or the run would have a smaller period, so the place q further
   on is one of the next three occurrences: three pairs a place are enough, and no group of equal grams is multiplied out.
3. Pairs of one lag are taken from left to right. A table says how far each lag has been covered; pairs before that place
   are not extended again. The others are extended over their whole diagonal match, compared word by word.

Defined results: null, empty and blank texts have no run and an empty collapsed text; texts without a run come back as their words joined by
one space; runs of several periods may overlap, and a word goes when any of them repeats it; null and repeated doc_ids are rows of their own; a
long text is worked on alone, in memory that follows its length; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import Words, blocks, mix, words

_U = np.uint64
LEAST = 24
NEXT = 3  # occurrences of a gram that are paired with each one
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
COLLAPSED = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
_FACTOR = _U(0x9E3779B97F4A7C15)


def bands(least: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, end of lags, gram length): the gram is no longer than the overlap that each lag of the band guarantees."""
    k = -(-2 * least // 3)
    lo, hi = 1, 3 * k // 4
    while lo <= longest // 3:
        yield lo, max(hi, lo + 1), k
        lo = max(hi, lo + 1)
        hi, k = lo + lo // 2, 2 * lo


class _Grams:
    """Hashes of grams of any length, from those of lengths that are powers of two. Grams that cross the end of a text have no meaning."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        m = k.bit_length() - 1
        while len(self.levels) <= m:
            last, d = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(mix(last[: max(len(last) - d, 0)] * _FACTOR + last[d:]))
        level = self.levels[m]
        return level[places] if k == 1 << m else mix(level[places] * _FACTOR + level[places + (k - (1 << m))])


def _pairs(grams: _Grams, text: np.ndarray, places: np.ndarray, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lags from lo to below hi) of the next NEXT occurrences of the gram at each of the places of one text, by lag and place."""
    key = mix(grams.at(places, k) + text[places].astype(_U) * _FACTOR)
    order = np.argsort(key, kind="stable")
    key, place = key[order], places[order]
    found = []
    for s in range(1, min(NEXT, len(key) - 1) + 1):
        lag = place[s:] - place[:-s]
        some = (key[s:] == key[:-s]) & (lag >= lo) & (lag < hi)
        found.append((place[:-s][some], lag[some]))
    at, lag = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (places[:0], places[:0])
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    chained = np.zeros(len(at), bool)  # the place before it has the same lag: one match
    chained[1:] = (lag[1:] == lag[:-1]) & (at[1:] - at[:-1] <= 1)
    return at[~chained], lag[~chained]


def _same(h: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from a on equal those from b on, going by step (1 or -1), at most `most`."""
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        x, y = a + step * done, b + step * done
        differ = h[x : x + n] != h[y : y + n] if step > 0 else (h[x - n + 1 : x + 1] != h[y - n + 1 : y + 1])[::-1]
        where = int(differ.argmax())
        if differ[where]:
            return done + where
        done, size = done + n, 2 * size
    return done


def _smallest(h: np.ndarray, start: int, period: int) -> bool:
    """Whether the stretch from start on, at least twice the period long, has no period that divides this one."""
    rest, p = period, 2
    while rest > 1:
        if rest % p == 0:
            d = period // p
            if np.array_equal(h[start : start + 2 * period - d], h[start + d : start + 2 * period]):
                return False
            while rest % p == 0:
                rest //= p
        p = p + 1 if p * p <= rest else max(rest, p + 1)
    return True


def find(w: Words, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of a block that has any, by start, then period."""
    h, size = w.hashes, np.diff(w.first)
    out: dict[int, list[tuple[int, int, int]]] = {}
    seed = -(-2 * least // 3)
    if not len(h) or size.max() < least:
        return out
    text = np.repeat(np.arange(len(size)), size)
    left = w.first[1:][text] - np.arange(len(h))  # words up to the end of the text
    grams = _Grams(h)
    places = np.flatnonzero(left >= seed)
    key = mix(grams.at(places, seed) + text[places].astype(_U) * _FACTOR)
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return out
    hit = places[np.isin(key, again)]  # places whose seed occurs twice in the text
    gap = np.flatnonzero(np.append(np.diff(hit) != 1, True))
    ends = hit[gap][np.searchsorted(gap, np.arange(len(hit)))]  # the last place of each stretch of such places
    for lo, hi, k in bands(least, int(size.max())):
        some = hit[(ends - hit >= k - seed) & (size[text[hit]] >= 3 * lo)]
        covered: dict[tuple[int, int], int] = {}
        for at, lag in zip(*(x.tolist() for x in _pairs(grams, text, some, k, lo, hi)), strict=True) if len(some) else ():
            t = int(text[at])
            if at < covered.get((t, lag), -1):
                continue
            first, end = int(w.first[t]), int(w.first[t + 1])
            start = at - _same(h, at - 1, at + lag - 1, at - first, -1)
            stop = at + _same(h, at, at + lag, end - at - lag, 1)
            covered[t, lag] = stop
            length = stop - start + lag
            if length >= max(least, 3 * lag) and _smallest(h, start, lag):
                out.setdefault(t, []).append((start - first, length, lag))
    return {t: sorted(set(found), key=lambda r: (r[0], r[2])) for t, found in out.items()}


def _repeated(w: Words, runs: dict[int, list[tuple[int, int, int]]]) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(len(w.starts) + 1, np.int64)
    for t, found in runs.items():
        for start, length, period in found:
            edge[w.first[t] + start + period] += 1
            edge[w.first[t] + start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(data: np.ndarray, w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space, as one string column."""
    starts, size = w.starts[keep], (w.ends - w.starts)[keep]
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[keep]
    count = np.bincount(text, minlength=len(w.first) - 1)
    own = np.bincount(text, weights=size, minlength=len(w.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(own + np.maximum(count - 1, 0))])
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    to = np.cumsum(size + ~first) - size
    out = np.full(int(offsets[-1]), 32, np.uint8)
    shift = np.repeat(starts - to, size)
    at = np.arange(len(shift)) + np.repeat(to - (np.cumsum(size) - size), size)
    out[at] = data[at + shift]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) as COLLAPSED: the runs of each text, and its words less those that repeat a period. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for block in blocks(batch.column("text")):
                w = words(block)
                found = find(w, least)
                off = np.concatenate([[0], np.cumsum([len(found.get(t, ())) for t in range(len(block))])]).astype(np.int32)
                flat = np.array([r for t in sorted(found) for r in found[t]], np.int64).reshape(-1, 3)
                runs = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], ["start", "length", "period"])).cast(kind)
                text = _joined(block.data, w, ~_repeated(w, found)).cast(pa.string())
                ids = batch.column("doc_id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.first).astype(np.int64)), runs, text], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, COLLAPSED)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def listed(runs: Column) -> Column:
    """The runs as text, `start,length,period` and a line feed each."""
    line = lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))])
    return F.array_join(F.transform(runs, line), "")
