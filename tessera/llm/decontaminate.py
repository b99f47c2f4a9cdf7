"""Benchmark decontamination: windows of a document that lie within a small word edit distance of a benchmark item.

Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z folded. A document leaks an item of m words
when one of its windows of m words (or what is left of the text, if less) is within k = floor(rate * m) word edits of it.

1. CGK: from every place of a text, and from every word of an item's window, a walk writes the word it stands on and moves to the next
   one when the repetition's random bit for that word and step says so. Where a text and an item go on alike, so do their walks, and after an
   edit they fall into step again with a constant chance: edit distance becomes Hamming distance. A walk does not depend on
   the length of its window, so windows of all item sizes share the walks of a text.
2. Bit sampling: each repetition samples SAMPLED places of the walk. Samples are taken behind every word of the item, so those of a repetition cover
   the whole window. k edits leave a stretch of at least (m - k) / (k + 1) words as they were, wherever they fall (head, tail, all in one
   place, spread out); samples behind its first word see nothing else. A place of a text whose samples agree with some of an item names the
   window that puts them over one another. The number of repetitions follows from the target recall at the shortest such stretch.
3. Windows that, with k words on both sides, share too few words with the item to be within k edits are dropped; for the others edit distance is
   computed exactly from all starts up to k words apart, as insertions and deletions shift a window; nothing is reported without it.

Items too short for an edit (k = 0) are looked up as whole runs of words; none is lost.

Items are held in blocks of at most BLOCK_WORDS words; each block is one pass over the documents, so nothing that grows is
broadcast whole. Documents are not shuffled.

Defined results: null, empty and blank texts leak nothing; items without a word are matched by no window; a null item_id and
items of equal text are reported each; repeated rows are judged one by one; empty tables give no leak; other columns
pass through keep_clean and are ignored by leaks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.blocks import Words, blocks, mix, words

_U = np.uint64
RATE = 0.2
RECALL = 0.97
SAMPLED, STEPS = 3, 6  # places sampled, the first step among them, of the first STEPS
STRETCH = 0.25  # chance that the samples behind the first word of the shortest stretch see all its SAMPLED words, each once
BLOCK_WORDS = 1_000_000
FIRST_BITS = 14, 19  # of the bitmaps of opening samples, for few items and for many
WINDOWS = 4096  # windows whose words are compared together
LEAKS = "doc_id long, item_id long, start long, n_words long, distance long"


def repetitions(recall: float = RECALL, stretch: float = STRETCH) -> int:
    """How many repetitions find a window at the largest distance with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - stretch))


def _places(reps: int) -> np.ndarray:
    """The sampled steps of each repetition, ascending from the first."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return np.array([[0, *np.sort(rng.choice(np.arange(1, STEPS), SAMPLED - 1, replace=False))] for _ in range(reps)])


def kept_words(m: int, k: int) -> int:
    """The longest stretch that k edits leave at least of m words."""
    return -(-(m - k) // (k + 1))


class _Bits:
    """The random bit of each word for each repetition and step, 64 of them at a time."""

    def __init__(self, h: np.ndarray):
        self.h, self.group, self.held = h, -1, None

    def move(self, at: np.ndarray, rep: int, step: int) -> np.ndarray:
        group, bit = divmod(rep * STEPS + step, 64)
        if group != self.group:
            self.group, self.held = group, mix(self.h + _U(0x9E3779B97F4A7C15 * (group + 1) & (1 << 64) - 1))
        return at + ((self.held[at] >> _U(bit)) & _U(1)).astype(np.int64)


def _walk(h: np.ndarray, bits: _Bits, at: np.ndarray, rep: int, steps: np.ndarray, pass_: Callable[[int, np.ndarray], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, where their walks stand at the last of the steps, keys of the words at the steps) of the walks from `at`.
    pass_ sees the keys at each sampled step and names those to go on with. h ends in padding that no walk leaves."""
    start, key, step = at, _U(0), 0
    for k, place in enumerate(steps.tolist()):
        while step < place:
            at, step = bits.move(at, rep, step), step + 1
        key = mix(key + h[at] + _U(k)) if k else h[at]
        some = pass_(k, key)
        if some is not None:
            start, at, key = start[some], at[some], key[some]
    return start, at, key


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    k: int


@dataclass
class Known:
    """Keys in ascending order, and the item and offset in it that each belongs to."""

    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> Known:
        by = np.argsort(keys, kind="stable")
        return Known(keys[by], items[by].astype(np.int32), offsets[by].astype(np.int32))

    def met(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, offset, place) where a key at a place is one of these."""
        left, right = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = np.flatnonzero(right > left)
        n = (right - left)[some]
        which = np.repeat(left[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.items[which].astype(np.int64), self.offsets[which].astype(np.int64), np.repeat(at[some], n)


@dataclass
class Items:
    """A block of items: the sampled keys of each repetition, and whole runs of the items without an edit."""

    items: list[Item]
    places: np.ndarray
    low: int = 0  # the bits of a key that the bitmaps hold
    first: np.ndarray | None = None  # which low bits the sampled words that walks set out from have
    opens: list[np.ndarray] = field(default_factory=list)  # by repetition, which low bits the keys have after the second sample
    keys: list[list[Known]] = field(default_factory=list)  # by repetition, keys of all samples, and of two for items whose stretch is no longer
    runs: dict[int, Known] = field(default_factory=dict)  # by length, hashes of whole items

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]], rate: float, recall: float = RECALL) -> Items:
        out = Items([], _places(repetitions(recall)))
        for block in blocks(pa.array([t for _, t in rows], pa.string())) if rows else ():
            w = words(block, lower=True)
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                if b > a:
                    out.items.append(Item(rows[block.first + i][0], w.hashes[a:b].copy(), int((b - a) * rate + 1e-9)))
        whole: dict[int, list[int]] = {}
        for n, item in enumerate(out.items):
            if not item.k:
                whole.setdefault(len(item.words), []).append(n)
        for m, own in whole.items():
            out.runs[m] = Known.of(_run_hash(np.stack([out.items[n].words for n in own])), np.array(own), np.zeros(len(own)))
        walked = [n for n, item in enumerate(out.items) if item.k]
        size = np.array([len(out.items[n].words) for n in walked], np.int64)
        out.low = (1 << min(max(FIRST_BITS[0], (64 * int(size.sum())).bit_length()), FIRST_BITS[1])) - 1
        out.first = np.zeros(out.low + 1, bool)
        if not walked:
            return out
        h = _padded(np.concatenate([out.items[n].words for n in walked]))
        ends = np.repeat(np.cumsum(size), size)
        item, offset = np.repeat(walked, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        short = np.array([kept_words(len(x.words), x.k) < SAMPLED for x in out.items])[item]
        bits, every = _Bits(h), np.arange(size.sum())
        out.first[(h[every] & _U(out.low)).astype(np.int64)] = True
        for rep, steps in enumerate(out.places):
            second = _walk(h, bits, every, rep, steps[:2], lambda _, key: None)
            third = _walk(h, bits, every, rep, steps, lambda _, key: None)
            two = (second[1] > every) & (second[1] < ends)  # samples of one word twice tell windows apart badly
            all_ = two & (third[1] > second[1]) & (third[1] < ends) & ~short
            two &= short
            opens = np.zeros(out.low + 1, bool)
            opens[(second[2][two | all_] & _U(out.low)).astype(np.int64)] = True
            out.opens.append(opens)
            out.keys.append([Known.of(second[2][two], item[two], offset[two]), Known.of(third[2][all_], item[all_], offset[all_])])
        return out


def _padded(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.zeros(STEPS + 1, np.uint64)])


def _run_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = mix(h + rows[:, c])
    return h


def distance(masks: dict[int, int], m: int, window: list[int]) -> int:
    """Word edit distance of an item of m words to a window, by bit vectors over the item; masks: where each word stands in the item."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, total = full, 0, m
    for word in window:
        here = masks.get(word, 0)
        vertical = here | down
        level = (((here & up) + up) ^ up) | here
        more, less = down | (full & ~(level | up)), up & level
        total += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return total


def _candidates(h: np.ndarray, first: np.ndarray, ends: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (item, start) of the windows that meet an item; first[i] and ends[i] are where the text of word i starts and ends."""
    padded, found = _padded(h), []
    bits, every = _Bits(padded), np.flatnonzero(items.first[(h & _U(items.low)).astype(np.int64)])
    for rep, steps in enumerate(items.places if items.opens else ()):
        opens, (two, all_) = items.opens[rep], items.keys[rep]
        met = []

        def passed(k, key, opens=opens, two=two, met=met):
            if k != 1:
                return None
            some = np.flatnonzero(opens[(key & _U(items.low)).astype(np.int64)])
            met.append((key[some], some) if len(two.keys) else None)
            return some

        some, last, key = _walk(padded, bits, every, rep, steps, passed)
        if met[0] is not None:
            found.append(two.met(met[0][0], every[met[0][1]]))
        inside = last < ends[some]
        found.append(all_.met(key[inside], some[inside]))
    place = np.arange(len(h))
    for m, known in items.runs.items():
        p = np.flatnonzero(place + m <= ends)
        run = np.zeros(len(p), np.uint64)
        for c in range(m):
            run = mix(run + h[p + c])
        found.append(known.met(run, p))
    if not found:
        return np.zeros((0, 2), np.int64)
    item, offset, at = (np.concatenate(c) for c in zip(*found, strict=True))
    start = np.maximum(at - offset, first[at])
    both = np.unique(item * len(padded) + start)
    return np.column_stack([both // len(padded), both % len(padded)])


def find(w: Words, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, words, distance) of the nearest, then first, window of each item that a text of a block leaks."""
    h, text = w.hashes, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    if not len(h):
        return []
    begin, ends = w.first[:-1][text], w.first[1:][text]
    met, out = _candidates(h, begin, ends, items), []
    if not len(met):
        return out
    cut = np.flatnonzero(np.append(True, met[1:, 0] != met[:-1, 0]))
    for a, b in zip(cut, np.append(cut[1:], len(met)), strict=True):
        n, start = int(met[a, 0]), met[a:b, 1]
        item = items.items[n]
        m, k = len(item.words), item.k
        own, near = np.unique(item.words), []
        reach = np.arange(-k, m + k)
        for c in range(0, len(start), WINDOWS):
            s = start[c : c + WINDOWS]
            at = s[:, None] + reach
            inside = (at >= begin[s][:, None]) & (at < ends[s][:, None])
            rows = h[np.minimum(np.maximum(at, 0), len(h) - 1)]
            same = own[np.minimum(np.searchsorted(own, rows), len(own) - 1)] == rows
            near += s[(same & inside).sum(axis=1) >= m - k].tolist()
        masks: dict[int, int] = {}
        for i, word in enumerate(item.words.tolist()):
            masks[word] = masks.get(word, 0) | 1 << i
        known: dict[int, int] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for s in near:
            t = int(text[s])
            first, end = int(w.first[t]), int(w.first[t + 1])
            for x in (s, *range(max(first, s - k), min(end - 1, s + k) + 1)):
                if x not in known:
                    known[x] = distance(masks, m, h[x : min(x + m, end)].tolist())
                    if known[x] <= k:
                        here = (known[x], x - first, min(m, end - x))
                        best[t] = min(best.get(t, here), here)
                if known[s] == 0:  # the window itself is the item
                    break
        out += [(t, n, at, size, d) for t, (d, at, size) in best.items()]
    return sorted(out)


def _item_blocks(benchmark: DataFrame, rate: float) -> Iterator[Items]:
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len((r[1] or "").split())
        if size > BLOCK_WORDS:
            yield Items.of(rows, rate)
            rows, size = [], 0
    yield Items.of(rows, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text): LEAKS, one row per row of docs and item it leaks."""
    found = None
    for items in _item_blocks(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                rows = []
                for block in blocks(batch.column("text")):
                    for i, n, start, size, d in find(words(block, lower=True), items):
                        rows.append((batch.column("doc_id")[block.first + i].as_py(), items.items[n].item_id, start, size, d))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "n_words", "distance"])

        made = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
        found = made if found is None else found.unionByName(made)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that leak no item; all columns as they are."""
    for items in _item_blocks(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in blocks(batch.column("text")):
                    for i, *_ in find(words(block, lower=True), shared.value):
                        clean[block.first + i] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
