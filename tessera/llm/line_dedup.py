"""Line dedup: remove every line that an earlier line of the corpus resembles.

A line is a `\\n`-split part of a text that holds a word; its tokens are its distinct words (runs of characters other than
0x20 and 0x09-0x0D, A-Z folded). Two lines match when Jaccard >= 0.8. Lines are ordered by doc_id (null first), then by
a hash of their text, then by place; a line goes when some earlier line, kept or not, matches it.

Exact set-similarity join:

1. Words are counted over all lines. Tokens are ordered by rarity: the ORDERED most frequent words by their counts, all
   other words, rarer than these, by hash. The order changes the work, never the result.
2. One pass over the texts makes postings of the prefix tokens of each line. Lines of equal words that a task has met are
   posted once. Postings travel in columns, one row per task and bucket of tokens, so a shuffle moves few rows.
3. Each bucket joins its postings: length filter, index prefix of the shorter line, positional filter, and a parity-sketch bound on
   the symmetric difference. A line needs one earlier match, so a bucket names at most `quota` of its nearest candidates per token (`few`
   where the sketches all but assure the nearest), and says where there are more. Large groups of near copies are first compared with the lines just before each.
4. Candidates are verified by the Jaccard of the whole token sets, the nearest of each line first, the others for lines still
   open. Lines with further candidates are taken up again with a quota sixteen times as large until none is open.

Tokens that occur more than `hot` times in the corpus may fill a bucket: their postings are dealt out in slices, passed through and
joined as rows, where Spark spills and splits skewed partitions.

Defined results: null, empty and blank texts are left as they are; blank lines are never removed; rows that repeat both
doc_id and text share their places and so lose the same lines; null doc_ids come first and count as earlier; a text whose every line
goes becomes empty; an empty table gives no rows; other columns pass through, whatever their names, and one named
n_lines_removed is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import Texts, Words, blocks, give_back, mix, packed, parity, unpacked, words
from tessera.llm.jaccard_join import SKETCH, Likeness, verified
from tessera.llm.shared import doc_key, doc_tie, looked_up, unused, written

_U = np.uint64
LIKE = Likeness(1, 8, 10)
ORDERED = 200_000
COUNTED = 1_000_000  # word hashes a task holds before it sums them
WORD_BITS, MOST_WORD_BITS = 10, 22
WORD_BYTES = 64 << 20  # texts whose words one part of the vocabulary sums
CHUNK = 1 << 19  # lines sorted together
LONG = 128  # tokens beyond which a line has a sketch of 256 bits beside that of 128, which is the sum of its halves
MOST = (1 << 20) - 1  # sizes from this on are ordered alike
OPEN_ROWS, TOKEN_ROWS = 4_000_000, 2_000_000  # largest sets that a further round broadcasts; without them it does more work
KNOWN = _U(1 << 43)  # order values below are rare words, those above are ranks
PLACE = ("doc", "tie", "line")
POSTED = "kind int, bucket long, size int, token binary, doc binary, tie binary, line binary, n binary, i binary, s0 binary, s1 binary, a0 binary, a1 binary"
FOUND = "kind int, doc long, tie long, line int, doc_b long, tie_b long, line_b int, apart int, more boolean, token long, n int, i int, s0 long, s1 long"
PREFIX, EQUAL, GONE, SLICE = 0, 1, 2, 3  # kinds of rows


@dataclass(frozen=True)
class Limits:
    """What tasks hold, and what is looked at first; they change the work, never the result."""

    seen: int = 30_000  # distinct lines a task remembers, so as to post equal lines once
    postings: int = 150_000  # postings a task holds before it hands them on
    bucket: int = 150_000  # postings meant for one bucket
    hot: int = 1_000_000  # occurrences of a word beyond which its postings are dealt in slices
    quota: int = 256  # candidates a bucket names for a line and token
    few: int = 2  # those it names where the nearest is all but sure
    large: int = 64  # postings of a token beyond which neighbours are looked at first
    neighbours: int = 16
    pairs: int = 150_000  # pairs a bucket looks at together


LIMITS = Limits()


def _lines(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its text, its number in the text, and the offsets of its words."""
    breaks = np.flatnonzero(t.data == 10)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    heads = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")  # where lines begin, empty ones included
    at = np.searchsorted(w.starts, heads)  # the first word of each line, or of the next that has one
    some = np.flatnonzero(at < np.append(at[1:], len(w.starts)))
    at, head = at[some], heads[some]
    text = np.searchsorted(t.offsets, w.starts[at], "right") - 1
    number = np.searchsorted(breaks, head) - np.searchsorted(breaks, t.offsets[:-1])[text]
    return text, number, np.append(at, len(w.starts))


def _line_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each line."""
    n = np.diff(off)
    place = np.arange(off[-1]) - np.repeat(off[:-1], n)
    return mix(np.add.reduceat(mix(h + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), off[:-1]) + n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)


class Order:
    """Order values of words: a hash table of the frequent ones, in whose open slots others are not found."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray):
        by = np.lexsort((words_, counts))
        ranked, self.counts = words_[by], counts[by]
        self.mask = (1 << max(4, int(2 * len(words_)).bit_length())) - 1
        self.rank = np.full(self.mask + 1, -1, np.int32)
        self.key = np.zeros(self.mask + 1, np.uint64)
        left, step = np.arange(len(ranked)), 0
        while len(left):
            slot = self._slot(ranked[left], step)
            free = self.rank[slot] < 0
            self.rank[slot[free]] = left[free]  # the last of equal slots stays
            self.key[slot] = ranked[self.rank[slot]]
            left, step = left[self.rank[slot] != left], step + 1

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> _U(20)) + _U(step)).astype(np.int64) & self.mask

    def values(self, h: np.ndarray) -> np.ndarray:
        out = h >> _U(21)
        left, step = np.arange(len(h)), 0
        while len(left):
            slot = self._slot(h[left], step)
            rank = self.rank[slot]
            found = (self.key[slot] == h[left]) & (rank >= 0)
            out[left[found]] = KNOWN + rank[found].astype(np.uint64)
            left, step = left[~found & (rank >= 0)], step + 1
        return out

    def hashes(self, value: np.ndarray) -> np.ndarray:
        """The upper 43 bits of the hashes of the words of these values."""
        known, used = value >= KNOWN, self.rank >= 0
        words_ = np.zeros(len(self.counts), np.uint64)
        words_[self.rank[used]] = self.key[used]
        out = value.copy()
        out[known] = words_[(value[known] - KNOWN).astype(np.int64)] >> _U(21)
        return out

    def slices(self, value: np.ndarray, hot: int) -> np.ndarray:
        """Into how many slices the postings of each token are dealt; 1 for all but hot ones."""
        out = np.ones(len(value), np.int64)
        known = value >= KNOWN
        if known.any():
            out[known] = -(-self.counts[(value[known] - KNOWN).astype(np.int64)].astype(np.int64) // hot)
        return out


def _counts(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """The words of a task and their counts, one row per bucket."""
    h, n = np.unique(np.concatenate(held), return_counts=True)
    bucket = (h >> _U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
    spans = list(zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(h)], strict=False))
    n = np.minimum(n, 2**31 - 1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), pa.array([int(b - a) for _, a, b in spans], pa.int32()), pa.array([packed(h[a:b], 8) for _, a, b in spans], pa.binary()), pa.array([packed(n[a:b], 4) for _, a, b in spans], pa.binary())], ["bucket", "size", "words", "counts"])


def word_order(docs: DataFrame, ordered: int = ORDERED) -> tuple[Order, int]:
    """The order by the most frequent words, at most `ordered` of them, and the number of all repeated words.
    The vocabulary is summed in as many parts as the texts have shares of WORD_BYTES."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(WORD_BITS, (size // WORD_BYTES).bit_length()), MOST_WORD_BITS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                held.append(words(block, lower=True).hashes)
                size += len(held[-1])
                if size > COUNTED:
                    yield _counts(held, bits)
                    held, size = [], 0
        if held:
            yield _counts(held, bits)

    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = zip(table.column("size").to_pylist(), table.column("words"), table.column("counts"), strict=True)
        w, n = zip(*((unpacked(x.as_buffer(), size, 8, np.uint64), unpacked(y.as_buffer(), size, 4, np.int32)) for size, x, y in parts), strict=True)
        w, at = np.unique(np.concatenate(w), return_inverse=True)
        n = np.bincount(at, np.concatenate(n)).astype(np.int64)  # exact up to 2^53
        return pa.table({"word": pa.array(w[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})

    counts = docs.select("text").mapInArrow(run, "bucket int, size int, words binary, counts binary")
    counts = written(counts.groupBy("bucket").applyInArrow(total, "word long, n long"), "word-counts")
    sizes = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)  # distinct counts are few
    fit = sizes[sizes["count"].cumsum() <= ordered]
    least = int(fit["n"].min()) if len(fit) else 1 << 62
    top = counts.where(F.col("n") >= least).toPandas()
    return Order(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)), int((sizes["n"] * sizes["count"]).sum())


def _keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    return docs.select(doc_key(F.col("doc_id")).alias("doc"), doc_tie(F.col("doc_id"), F.col("text")).alias("tie"), "text", *more)


def _widths(kind: int) -> tuple[int, ...]:
    """Bytes of the columns of a posting."""
    return 6 if kind in (PREFIX, SLICE) else 8, 8, 8, 4, 4, 4, 8, 8, 8, 8


PLANES = (False, True, False, True, True, True, False, False, False, False)  # columns with many equal high bytes


class _Held:
    """Postings of a task, by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.size, self.held = buckets, 0, {PREFIX: [], EQUAL: [], GONE: [], SLICE: []}

    def add(self, kind: int, bucket: np.ndarray, token: np.ndarray, doc: np.ndarray, tie: np.ndarray, line: np.ndarray, *rest: np.ndarray) -> None:
        if len(bucket):
            self.held[kind].append((bucket, token, doc, tie, line.astype(np.int32), *rest))
            self.size += len(bucket)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, held in self.held.items():
            if not held:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            by = np.argsort(columns[0], kind="stable")
            columns = [c[by] for c in columns]
            cut = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
            ends = np.append(cut[1:], len(by))
            made = [[packed(c[a:b], w, p) for a, b in zip(cut, ends, strict=True)] for c, w, p in zip(columns[1:], _widths(kind), PLANES, strict=False)]
            made += [[b""] * len(cut)] * (10 - len(made))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(cut), pa.int32()), pa.array(columns[0][cut]), pa.array((ends - cut).astype(np.int32)), *(pa.array(m, pa.binary()) for m in made)], [x.split()[0] for x in POSTED.split(", ")])
        self.size, self.held = 0, {PREFIX: [], EQUAL: [], GONE: [], SLICE: []}


def _prefixes(h: np.ndarray, off: np.ndarray, order: Order, like: Likeness) -> Iterator[tuple[np.ndarray, ...]]:
    """(line, token, n, i, s0, s1, a0, a1) of the prefix tokens of lines, some lines at a time."""
    for a in range(0, len(off) - 1, CHUNK):
        own = off[a : a + CHUNK + 1]
        value = order.values(h[own[0] : own[-1]])
        key = np.sort((np.repeat(np.arange(len(own) - 1, dtype=np.uint64), np.diff(own)) << _U(44)) | value)
        key = key[np.append(True, key[1:] != key[:-1])]
        line, value = (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1)
        first = np.searchsorted(line, np.arange(len(own)))
        n = np.diff(first)
        a0, a1, b0, b1 = parity(value, first, 4)
        s0, s1 = a0 ^ b0, a1 ^ b1
        a0[n <= LONG], a1[n <= LONG] = 0, 0
        prefix = n + n * like.num // -like.den + 1
        which = np.repeat(np.arange(len(n)), prefix)
        i = np.arange(len(which)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        yield a + which, value[first[:-1][which] + i], n[which].astype(np.int32), i.astype(np.int32), s0[which], s1[which], a0[which], a1[which]


def postings(docs: DataFrame, order: Order, buckets: int, like: Likeness, only: np.ndarray | None = None, limits: Limits = LIMITS) -> DataFrame:
    """POSTED rows of docs (doc_id, text); of the tokens in `only` alone, where it is given."""
    shared = docs.sparkSession.sparkContext.broadcast((order, only))

    def run(batches):
        order, only = shared.value
        held, seen, own = _Held(buckets), {}, TaskContext.get().partitionId()
        opens = np.zeros(1 << 20, bool)
        if only is not None:
            opens[(order.hashes(only) & _U(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            docs_, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for block in blocks(batch.column("text")):
                w = words(block, lower=True)
                text, number, off = _lines(block, w)
                if only is not None and len(text):  # few lines hold one of a few tokens
                    some = np.flatnonzero(np.logical_or.reduceat(opens[((w.hashes >> _U(21)) & _U(0xFFFFF)).astype(np.int64)], off[:-1]))
                    text, number, n = text[some], number[some], np.diff(off)[some]
                    first = np.append(0, np.cumsum(n))
                    w.hashes = w.hashes[np.repeat(off[some] - first[:-1], n) + np.arange(first[-1])]
                    off = first
                if not len(text):
                    continue
                doc, tie = docs_[text + block.first], ties[text + block.first]
                ids = _line_ids(w.hashes, off)
                keep = np.zeros(len(ids), bool)
                gone = []
                for k in np.lexsort((number, tie, doc)).tolist():
                    place = (int(doc[k]), int(tie[k]), int(number[k]))
                    before = seen.get(i := int(ids[k]))
                    if before is None or place < before:
                        keep[k], seen[i] = True, place
                        if before is not None:
                            gone.append(before)
                    elif place != before:
                        gone.append(place)
                if gone:
                    at = [np.array(c, np.int64) for c in zip(*gone, strict=True)]
                    held.add(GONE, np.full(len(gone), own, np.int64), at[0], *at)
                at = np.flatnonzero(keep)
                held.add(EQUAL, (ids[at] % _U(buckets)).astype(np.int64), ids[at], doc[at], tie[at], number[at])
                n = np.diff(off)[at]
                first = np.append(0, np.cumsum(n))
                h = w.hashes[np.repeat(off[:-1][at] - first[:-1], n) + np.arange(first[-1])]
                for line, token, *rest in _prefixes(h, first, order, like):
                    line = at[line]
                    if only is not None:
                        x = only[np.minimum(np.searchsorted(only, token), len(only) - 1)] == token
                        line, token, rest = line[x], token[x], [c[x] for c in rest]
                    slices = order.slices(token, limits.hot)
                    scatter = mix(token) + _U(0x51ED) * (ids[line] % slices.astype(np.uint64))
                    bucket = np.where(slices > 1, mix(scatter) % _U(1 << 40), mix(token) % _U(buckets)).astype(np.int64)
                    for kind, x in ((PREFIX, slices == 1), (SLICE, slices > 1)):
                        held.add(kind, bucket[x], token[x], doc[line[x]], tie[line[x]], number[line[x]], *(c[x] for c in rest))
                if held.size > limits.postings:
                    yield from held.rows()
                if len(seen) > limits.seen:
                    seen.clear()
        yield from held.rows()

    return _keyed(docs).mapInArrow(run, POSTED)


class _Bucket:
    """The postings of one bucket, ordered by token and size."""

    def __init__(self, columns: list[np.ndarray], like: Likeness, limits: Limits = LIMITS):
        self.like, self.limits = like, limits
        order = np.argsort(columns[0] << _U(20) | np.minimum(columns[4], MOST).astype(np.uint64))
        self.token, self.doc, self.tie, self.line, self.n, self.i, self.s0, self.s1, self.a0, self.a1 = (c[order] for c in columns)
        self.n, self.i = self.n.astype(np.int64), self.i.astype(np.int64)
        self.group = np.cumsum(np.append(True, self.token[1:] != self.token[:-1])) - 1
        self.first = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        self.size = np.diff(np.append(self.first, len(self.group)))
        self.unseen = np.zeros(len(self.n), bool)  # postings of which some earlier line was not looked at, or not named
        self.index = self.n - (-(-2 * like.num * self.n // (like.den + like.num))) + 1  # index prefix of a line that meets one as long or longer

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where the line of x comes before that of y."""
        a, b = self.doc[x], self.doc[y]
        c, d = self.tie[x], self.tie[y]
        return (a < b) | ((a == b) & ((c < d) | ((c == d) & (self.line[x] < self.line[y]))))

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(later, earlier, sketch distance) of the pairs (x, y) of postings of one token that may match."""
        swap = self.n[x] > self.n[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        nx, ny, ix, like = self.n[x], self.n[y], self.i[x], self.like
        apart = (nx + ny) * (like.den - like.num) // (like.den + like.num)
        # these filters hold at the first token that the two prefixes share, and in every pair of which it is the first
        ok = np.flatnonzero((like.den * nx >= like.num * ny) & (ix < self.index[x]) & (ix + self.i[y] <= apart))
        x, y, apart = x[ok], y[ok], apart[ok]
        d = np.bitwise_count(self.s0[x] ^ self.s0[y]).astype(np.int64) + np.bitwise_count(self.s1[x] ^ self.s1[y])
        ok = np.flatnonzero(d <= apart)
        x, y, apart, d = x[ok], y[ok], apart[ok], d[ok]
        both = np.flatnonzero((self.n[x] > LONG) & (self.n[y] > LONG))
        if len(both):
            v, w = x[both], y[both]
            a0, a1 = self.a0[v] ^ self.a0[w], self.a1[v] ^ self.a1[w]
            d[both] = sum(np.bitwise_count(z).astype(np.int64) for z in (a0, a1, a0 ^ self.s0[v] ^ self.s0[w], a1 ^ self.s1[v] ^ self.s1[w]))
            ok = np.flatnonzero(d <= apart)
            x, y, d = x[ok], y[ok], d[ok]
        later, earlier = self.before(y, x), self.before(x, y)
        some = later | earlier  # a repeated row has equal places
        return np.where(later, x, y)[some], np.where(later, y, x)[some], d[some]

    def candidates(self, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """near() of all pairs, in parts. In large groups, lines with a sure candidate among their neighbours are compared no further, and
        are unseen."""
        many = self.size[self.group] > self.limits.large
        if not many.all():
            small = np.flatnonzero(~many)
            longest = np.searchsorted(self._ordered, self._order_of(small, self.n[small] * self.like.den // self.like.num), "right")
            yield from self._all(small, small + 1, longest, wanted, both=True)
        if many.any():
            at = np.flatnonzero(many)
            at = at[np.lexsort((self.line[at], self.tie[at], self.doc[at], self.group[at]))]
            rank = np.arange(len(at)) - np.searchsorted(self.group[at], self.group[at])
            some = np.zeros(len(self.n), bool)
            for shift in range(1, self.limits.neighbours + 1):
                k = np.flatnonzero(rank >= shift)
                if wanted is not None:
                    k = k[wanted[at[k]]]
                x, y, d = self.near(at[k], at[k - shift])
                some[x[self.sure(x, y, d)]] = True
                yield x, y, d
            self.unseen |= some
            rest = np.flatnonzero(many & ~some & (True if wanted is None else wanted))
            low = np.searchsorted(self._ordered, self._order_of(rest, -(-self.n[rest] * self.like.num // self.like.den)), "left")
            high = np.searchsorted(self._ordered, self._order_of(rest, self.n[rest] * self.like.den // self.like.num), "right")
            yield from self._all(rest, low, high, None, both=False)

    def sure(self, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Where the sketches all but assure a match: the difference that their bits make likely, and a margin, are small enough."""
        most = (self.n[x] + self.n[y]) * (self.like.den - self.like.num) // (self.like.den + self.like.num)
        half = np.where((self.n[x] > LONG) & (self.n[y] > LONG), 128, 64)
        return -half * np.log1p(-np.minimum(d, half - 1) / half) * 1.2 + 2 <= most

    @functools.cached_property
    def _ordered(self) -> np.ndarray:
        return self._order_of(np.arange(len(self.n)), self.n)

    def _order_of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.group[at] << 20) + np.minimum(n, MOST)

    def _all(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, later: np.ndarray | None, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
        count = np.maximum(high - low, 0)
        total = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.limits.pairs, "right")))
            c = count[a:b]
            x = np.repeat(at[a:b], c)
            y = np.repeat(low[a:b] - (np.cumsum(c) - c), c) + np.arange(len(x))
            if not both:
                own = self.before(y, x)
                x, y = x[own], y[own]
            x, y, d = self.near(x, y)
            if later is not None:
                x, y, d = x[later[x]], y[later[x]], d[later[x]]
            yield x, y, d
            a = b


def _best(parts: list[tuple[np.ndarray, ...]], b: _Bucket) -> tuple[np.ndarray, ...]:
    """The nearest candidates of each line and token; lines that lose others become unseen, and stay so. Ties are broken by
    a hash, so that no line of a group is the candidate of all others."""
    x, y, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((mix(b.s0[y] + b.s1[x] + y.astype(np.uint64)), d, x))
    x, y, d = x[by], y[by], d[by]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    x, y, d = x[new], y[new], d[new]
    first = np.searchsorted(x, x)
    quota = np.where(b.sure(x[first], y[first], d[first]), b.limits.few, b.limits.quota)
    keep = np.arange(len(x)) - first < quota
    b.unseen[x[~keep]] = True
    return x[keep], y[keep], d[keep]


def _found(kind: int, size: int, **columns: np.ndarray) -> pa.RecordBatch:
    fields = [f.split() for f in FOUND.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    columns["kind"] = np.full(size, kind)
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) if n in columns else pa.nulls(size, types[t]) for n, t in fields], [n for n, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _places(doc: np.ndarray, tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each place."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + mix(tie.astype(np.int64).view(np.uint64) ^ _U(0x7F4A7C15)) + line.astype(np.uint64))


def _join(columns: list[np.ndarray], like: Likeness, limits: Limits, open_: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Candidates of the postings of one bucket."""
    b = _Bucket(columns, like, limits)
    wanted = None
    if open_ is not None:
        p = _places(b.doc, b.tie, b.line)
        wanted = open_[np.minimum(np.searchsorted(open_, p), len(open_) - 1)] == p
    parts = []
    for part in b.candidates(wanted):
        if len(part[0]):
            parts.append(part)
            if sum(len(p[0]) for p in parts) > limits.pairs:
                parts = [_best(parts, b)]
    if not parts:
        return
    x, y, d = _best(parts, b)
    more = b.unseen[x]
    p, q = _places(b.doc[x], b.tie[x], b.line[x]), _places(b.doc[y], b.tie[y], b.line[y])
    by = np.lexsort((~more, q, p))  # a pair may meet under several tokens
    x, y, d, more, p, q = x[by], y[by], d[by], more[by], p[by], q[by]
    new = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | more[1:])
    x, y, d, more = x[new], y[new], d[new], more[new]
    yield _found(PREFIX, len(x), doc=b.doc[x], tie=b.tie[x], line=b.line[x], doc_b=b.doc[y], tie_b=b.tie[y], line_b=b.line[y], apart=d, more=more, token=b.token[x].view(np.int64))


def candidates(posted: DataFrame, like: Likeness = LIKE, open_: np.ndarray | None = None, limits: Limits = LIMITS) -> DataFrame:
    """FOUND rows: pairs of a line and an earlier one, lines that an equal line precedes, and slices of hot tokens."""
    shared = posted.sparkSession.sparkContext.broadcast(open_)
    names = [x.split()[0] for x in POSTED.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        kind = key[0].as_py()
        sizes = table.column("size").to_pylist()
        types = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, *[np.uint64] * 4)
        columns = [np.concatenate([unpacked(r.as_buffer(), n, w, t, p) for r, n in zip(table.column(c), sizes, strict=True)]) if len(table.column(c)[0].as_buffer()) else None for c, w, t, p in zip(names[3:], _widths(kind), types, PLANES, strict=True)]
        token, doc, tie, line = columns[:4]
        if kind == PREFIX:
            made = list(_join(columns, like, limits, shared.value))
        elif kind == EQUAL:
            by = np.lexsort((line, tie, doc, token))
            first = by[np.searchsorted(token[by], token[by])]
            again = by[(doc[by] != doc[first]) | (tie[by] != tie[first]) | (line[by] != line[first])]  # a repeated row shares its places
            made = [_found(GONE, len(again), doc=doc[again], tie=tie[again], line=line[again])]
        elif kind == GONE:
            made = [_found(GONE, len(doc), doc=doc, tie=tie, line=line)]
        else:  # near copies mostly find one another in one slice; what stays open meets the other slices as rows
            made = [r.set_column(8, "more", pa.array(np.zeros(len(r), bool))) for r in _join(columns, like, limits, shared.value)]
            made += [_found(SLICE, len(doc), **{c: _signed(x) for c, x in zip(names[3:11], columns, strict=False)})]
        return pa.Table.from_batches(made, _found(GONE, 0).schema)

    return posted.groupBy("kind", "bucket").applyInArrow(run, FOUND)


def _hot_pairs(slices: DataFrame, settled: DataFrame, like: Likeness) -> DataFrame:
    """All candidates under hot tokens of lines not settled, joined as rows: (doc, tie, line, doc_b, tie_b, line_b, apart).
    Matching lines lie in the same band of sizes or in neighbouring ones, so lines meet by token and band."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(like.den / like.num)) + 1e-9).cast("int")
    a = slices.join(settled, list(PLACE), "left_anti").withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("a")
    b = slices.withColumn("band", band).alias("b")
    na, nb = F.col("a.n").cast("long"), F.col("b.n").cast("long")
    most = F.floor((na + nb) * (like.den - like.num) / (like.den + like.num))
    index = lambda n: n - F.ceil(2 * like.num * n / (like.den + like.num)) + 1
    first = F.when(na <= nb, F.col("a.i") < index(na)).otherwise(F.col("b.i") < index(nb))
    d = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    place = lambda t: F.struct(*(f"{t}.{c}" for c in PLACE))
    passes = (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & (place("a") > place("b")) & (like.den * na >= like.num * nb) & (like.den * nb >= like.num * na) & first & (F.col("a.i") + F.col("b.i") <= most) & (d <= most)
    pairs = a.join(b, passes).select(*(f"a.{c}" for c in PLACE), *(F.col(f"b.{c}").alias(f"{c}_b") for c in PLACE), d.cast("int").alias("apart"))
    return pairs.distinct()


def token_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, tie, line, n, grams, sketch) of the wanted lines (doc, tie, line)."""
    lists = written(wanted.groupBy("doc", "tie").agg(F.collect_set("line").alias("lines")), "wanted-lines")  # bounded by a text's lines
    rows = looked_up(_keyed(docs), lists, ["doc", "tie"], "inner")

    def run(batches):
        for batch in batches:
            wants = batch.column("lines")
            for block in blocks(batch.column("text")):
                want = wants.slice(block.first, len(block))
                lines = want.flatten().to_numpy()
                of = np.repeat(np.arange(len(block)), want.value_lengths().to_numpy())
                breaks = np.append(np.flatnonzero(block.data == 10), len(block.data))
                base = np.searchsorted(breaks, block.offsets[:-1])[of] + lines
                start = np.where(lines > 0, breaks[np.maximum(base - 1, 0)] + 1, block.offsets[:-1][of])
                end = np.minimum(breaks[base], block.offsets[1:][of])
                off = np.append(0, np.cumsum(end - start))
                data = block.data[np.repeat(start - off[:-1], end - start) + np.arange(off[-1])]
                w = words(Texts(0, off, data), lower=True)
                by = np.lexsort((w.hashes, np.repeat(np.arange(len(of)), np.diff(w.first))))
                h, line = w.hashes[by], np.repeat(np.arange(len(of)), np.diff(w.first))[by]
                new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])) if len(h) else np.zeros(0, bool)
                h, first = h[new], np.searchsorted(line[new], np.arange(len(of) + 1))
                keep = np.flatnonzero(np.diff(first) > 0)
                for a in range(0, len(keep), 20000):
                    k = keep[a : a + 20000]
                    own = np.append(0, np.cumsum(np.diff(first)[k]))
                    grams = h[np.repeat(first[:-1][k] - own[:-1], np.diff(own)) + np.arange(own[-1])]
                    sketch = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(parity(grams, own, SKETCH), 1).view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64()))
                    row = pa.array(of[k] + block.first)
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(row), batch.column("tie").take(row), pa.array(lines[k], pa.int32()), pa.array(np.diff(own)), pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(grams.view(np.int64))), sketch], ["doc", "tie", "line", "n", "grams", "sketch"])

    made = rows.select("doc", "tie", "lines", "text").mapInArrow(run, "doc long, tie long, line int, n long, grams array<long>, sketch array<long>")
    made = written(made, "line-tokens")
    if made.groupBy(*PLACE).count().where("count > 1").limit(1).count():
        made = made.dropDuplicates(list(PLACE))  # rows that repeat id and text
    return made


def _matched(docs: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """(doc, tie, line) of lines with a verified candidate. pairs: (doc, tie, line, doc_b, tie_b, line_b, apart)."""
    ids = lambda s: F.xxhash64(*(c + s for c in PLACE))
    pairs = written(pairs.withColumn("a", ids("")).withColumn("b", ids("_b")), "pairs")
    ends = pairs.select(*PLACE).unionByName(pairs.select(*(F.col(f"{c}_b").alias(c) for c in PLACE))).distinct()
    tokens = token_table(docs, ends).withColumn("set_id", ids("")).select("set_id", "n", "grams", "sketch")
    nearest = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    done = written(verified(nearest, tokens, like).select("a").distinct(), "nearest")
    rest = pairs.select("a", "b").join(done, "a", "left_anti").join(nearest, ["a", "b"], "left_anti")
    done = done.unionByName(verified(rest, tokens, like).select("a").distinct())
    return pairs.join(done, "a", "left_semi").select(*PLACE).distinct()


def gone_lines(docs: DataFrame, like: Likeness = LIKE, limits: Limits = LIMITS) -> DataFrame:
    """(doc, tie, line) of every line that an earlier one matches."""
    order, total = word_order(docs)
    buckets = max(1, total // 4 // limits.bucket)
    found = written(candidates(postings(docs, order, buckets, like, limits=limits), like, limits=limits), "candidates")
    gone = found.where(F.col("kind") == GONE).select(*PLACE)
    pair = [*PLACE, *(f"{c}_b" for c in PLACE), "apart"]
    near = found.where(F.col("kind") == PREFIX)
    slices = found.where(F.col("kind") == SLICE)
    pairs = near.groupBy(*pair[:-1]).agg(F.min("apart").alias("apart")).join(gone, list(PLACE), "left_anti")  # equal lines need no verification
    gone = written(gone.unionByName(_matched(docs, pairs, like)).distinct(), "gone-lines")
    if slices.limit(1).count():
        gone = written(gone.unionByName(_matched(docs, _hot_pairs(slices, gone, like), like)).distinct(), "gone-lines")
    while True:
        open_ = written(near.where("more").select(*PLACE, "token").distinct().join(gone, list(PLACE), "left_anti"), "open-lines")
        count = open_.count()
        if not count:
            return gone
        limits = replace(limits, quota=limits.quota * 16, few=limits.quota * 16, neighbours=0)
        tokens = open_.select("token").distinct()
        only = np.sort(tokens.toPandas()["token"].to_numpy(np.int64).view(np.uint64)) if tokens.count() <= TOKEN_ROWS else None
        lines = None
        if count <= OPEN_ROWS:
            at = open_.select(*PLACE).distinct().toPandas()
            lines = np.sort(_places(*(at[c].to_numpy() for c in PLACE)))
        found = written(candidates(postings(docs, order, buckets, like, only, limits), like, lines, limits).where(F.col("kind") == PREFIX), "candidates")
        near = found.join(open_.select(*PLACE).distinct(), list(PLACE), "left_semi")
        more = _matched(docs, near.groupBy(*pair[:-1]).agg(F.min("apart").alias("apart")), like)
        gone = written(gone.unionByName(more).distinct(), "gone-lines")


def dedup_lines(docs: DataFrame, like: Likeness = LIKE, text: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """docs with its text less the lines that go, and n_lines_removed; the order of what stays is kept."""
    base = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    kept = docs.drop("n_lines_removed")
    doc, tie, gone = unused(kept, "doc", "tie", "gone")
    lists = gone_lines(base, like, limits).groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.collect_set("line").alias(gone))
    t = F.col(f"`{text}`")
    keyed = kept.withColumn(doc, doc_key(F.col("doc_id"))).withColumn(tie, doc_tie(F.col("doc_id"), t))
    out = looked_up(keyed, written(lists, "removed"), [doc, tie], "left")
    out = out.withColumn(doc, F.when(F.col(gone).isNotNull(), F.split(t, "\n", -1)))  # once, not once per line
    left = F.array_except(F.sequence(F.lit(0), F.size(doc) - 1), F.col(gone))
    new = F.when(F.col(gone).isNull(), t).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(doc), i)), "\n"))
    names = [F.col(f"`{c}`") if c != text else new.alias(text) for c in kept.columns]
    return out.select(*names, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_lines_removed"))
