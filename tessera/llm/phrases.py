"""Collocations: phrases whose words occur together more often than apart, counted over whole texts, by language.

Texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`, A-Z folded. A suffix is a place of a piece with the
words that follow it, `most` of them; a phrase occurs as often as suffixes begin with it. Words of a language are told apart by 64-bit hash.

1. Words are counted over all texts. A phrase with a word below `least` is below it too.
2. Suffixes are routed by their leading words: by the first, where that is frequent by the first two, where both are by three, and so on, so that no
   part of the work holds more than one word's fair share. A frequent beginning is a suffix of its own, routed by all its words.
3. Multikey three-way quicksort of suffix pointers: every segment is split at a pivot into less, equal and greater, by one word at a time; an equal
   segment goes on with the next word, down to `most`. All segments of a batch are split together. The sizes of equal segments are the counts. A task that reads
   texts sorts its own suffixes so, and hands on each distinct one with its count; where they meet, counts are the weights of the pointers,
   and a segment that weighs less than `least` is abandoned: nothing below it can reach that.
4. Candidates are scored by their weakest cut, in exact decimals (products below 10^38: counts below 10^16), and those mostly inside a longer one are dropped.

Frequent words are at most FREQUENT, whatever the input; only they are broadcast.

Defined results: a null text is empty; a null language counts as `und`, and a language without a candidate gives no row; repeated rows count each;
a long text is read in blocks and no phrase is longer than `most` words; ties are broken by the text of the phrase; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import Texts, blocks, mix, span_hashes
from tessera.llm.shared import broadcast_if_small, written

_U = np.uint64
FREQUENT = 1_000_000
LOOKUP_ROWS = 300_000  # largest table of counts that is broadcast
COUNTED = "lang string, key long, word string, n long"
ROUTED = "kind int, bucket int, levels array<binary>"
FOUND = "words array<long>, a long"
SCORED = "lang", "rank", "phrase", "a", "l", "r", "n", "score"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP[[9, 32]] = True
_GAP |= _BREAK


@dataclass(frozen=True)
class Limits:
    """What tasks hold; they change the work, never the result."""

    words: int = 1_000_000  # distinct words of blocks that a task holds before it sums them
    suffixes: int = 1_000_000  # suffixes a task sorts together
    bucket: int = 150_000  # suffixes meant for one bucket
    frequent: int = 100_000  # occurrences of a word beyond which the next word takes part in routing


LIMITS = Limits()


@dataclass
class Words:
    """The words of a block: bounds in the lowered bytes, key, text; follows says whether the next word is in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    text: np.ndarray
    follows: np.ndarray


def words(t: Texts, langs: np.ndarray) -> Words:
    """langs: a hash of the language of each text, which takes part in the keys. No key is 0."""
    data = _LOWER[t.data]
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[t.offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text = np.searchsorted(t.offsets, starts, "right") - 1
    keys = mix(span_hashes(data, starts, ends) + mix(langs[text]))
    keys[keys == 0] = 1
    piece = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return Words(data, starts, ends, keys, text, follows)


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words at some places, as strings."""
    size = (w.ends - w.starts)[at]
    off = np.concatenate([[0], np.cumsum(size)])
    data = w.data[np.repeat(w.starts[at] - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _summed(held: list[tuple]) -> pa.RecordBatch:
    keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    keys, at, of = np.unique(keys, return_index=True, return_inverse=True)
    lang, word = (pa.concat_arrays([h[c] for h in held]).take(pa.array(at)) for c in (2, 3))
    n = np.bincount(of, n).astype(np.int64)  # exact up to 2^53
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(keys.view(np.int64)), word.cast(pa.string()), pa.array(n)], ["lang", "key", "word", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), "text")


def word_counts(docs: DataFrame, least: int, limits: Limits = LIMITS) -> DataFrame:
    """COUNTED rows of docs (text, lang): words that occur `least` times or more, and per language all occurrences, with key 0 and no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, {}
        for batch in batches:
            langs, names = batch.column("lang_key").to_numpy().view(_U), batch.column("lang")
            for block in blocks(batch.column("text")):
                w = words(block, langs[block.first : block.first + len(block)])
                for name, n in zip(*np.unique(names.slice(block.first, len(block)).to_numpy(zero_copy_only=False)[w.text], return_counts=True), strict=True):
                    total[name] = total.get(name, 0) + int(n)
                keys, at, n = np.unique(w.keys, return_index=True, return_counts=True)
                held.append((keys, n, names.take(pa.array(w.text[at] + block.first)).cast(pa.large_string()), _strings(w, at)))
                size += len(keys)
                if size > limits.words:
                    yield _summed(held)
                    held, size = [], 0
        if held:
            yield _summed(held)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array([0] * len(total)), pa.nulls(len(total), pa.string()), pa.array(total.values(), pa.int64())], ["lang", "key", "word", "n"])

    found = _texts(docs).mapInArrow(run, COUNTED).groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    return written(found.where((F.col("n") >= least) | (F.col("key") == 0)), "phrase-words")


def split(pointers: np.ndarray, start: np.ndarray, size: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Three-way quicksort of the segments start, start + size of pointers by the values they point to, all segments at a time; pointers is
    reordered in place. Returns where the equal segments start, in order."""
    done = []
    value = column[pointers]
    while len(start):
        one = size == 1
        done.append(start[one])
        start, size = start[~one], size[~one]
        if not len(start):
            break
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(first[-1] + size[-1])
        p, v = pointers[at], value[at]
        a, b, c = v[first], v[first + size // 2], v[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, equal = v < pivot, v == pivot
        n_less, n_equal = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(equal, first, dtype=np.int64)
        place = np.empty(len(p), np.int64)
        for some, begin in ((less, start), (equal, start + n_less), (~(less | equal), start + n_less + n_equal)):
            k = np.flatnonzero(some)
            n = np.add.reduceat(some, first, dtype=np.int64)
            place[k] = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(k))
        pointers[place], value[place] = p, v
        done.append(start + n_less)
        more = size - n_less - n_equal
        start = np.concatenate([start[n_less > 0], (start + n_less + n_equal)[more > 0]])
        size = np.concatenate([n_less[n_less > 0], more[more > 0]])
    return np.sort(np.concatenate(done)) if done else start


def _routes(columns: list[np.ndarray], frequent: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(how many leading words route them, suffixes) of all suffixes of two words or more, and of their frequent beginnings."""
    most = len(columns)
    length = np.add.reduce([c != 0 for c in columns])
    by, all_ = np.ones(len(length), np.int64), np.ones(len(length), bool)
    for c in columns[: most - 1]:
        if len(frequent):
            all_ &= frequent[np.minimum(np.searchsorted(frequent, c), len(frequent) - 1)] == c
            by += all_
    by = np.minimum(by, length)
    for kind in range(1, most + 1):
        own = np.flatnonzero((by == kind) & (length > 1))
        cut = np.flatnonzero(by > kind) if kind > 1 else own[:0]
        if len(own) + len(cut):
            yield kind, [np.concatenate([c[own], c[cut] if i < kind else np.zeros(len(cut), _U)]) for i, c in enumerate(columns)]


def _narrow(n: np.ndarray) -> bytes:
    """Small counts by one byte each, others by four."""
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def _sorted_rows(kind: int, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """ROUTED rows: distinct suffixes of each bucket as the levels of a tree, words and numbers of children, and at the last level counts."""
    route = columns[0]
    for c in columns[1:kind]:
        route = mix(route + c)
    bucket = (mix(route) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    pointers = np.argsort(bucket, kind="stable")
    bucket = bucket[pointers]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    start, levels = edges, []
    for c in columns:
        start = split(pointers, start, np.diff(np.append(start, len(pointers))), c)
        levels.append(start)
    ends = np.append(edges[1:], len(pointers))
    children = [np.diff(np.append(np.searchsorted(b, a), len(b))) for a, b in zip(levels[:-1], levels[1:], strict=True)]
    children.append(np.diff(np.append(levels[-1], len(pointers))))
    made: list[list[bytes]] = [[] for _ in edges]
    for c, own, n in zip(columns, levels, children, strict=True):
        value = c[pointers[own]]
        low, high = np.searchsorted(own, edges), np.searchsorted(own, ends)
        for row, a, b in zip(made, low.tolist(), high.tolist(), strict=True):
            row += [value[a:b].tobytes(), _narrow(n[a:b])]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(edges), pa.int32()), pa.array(bucket[edges].astype(np.int32)), pa.array(made, pa.list_(pa.binary()))], ["kind", "bucket", "levels"])


def _unrouted(levels: list[pa.Scalar], most: int) -> list[np.ndarray]:
    """The suffixes and counts of one ROUTED row."""
    out: list[np.ndarray] = []
    for i in range(most):
        value = np.frombuffer(levels[2 * i].as_buffer(), np.uint64)
        raw = levels[2 * i + 1].as_buffer()
        n = np.frombuffer(raw, np.uint8 if raw.size == len(value) else np.uint32).astype(np.int64)
        out = [np.repeat(c, n) for c in (*out, value)] if i < most - 1 else [*out, value, n]
    return out


def routed(docs: DataFrame, most: int, frequent: np.ndarray, buckets: int, limits: Limits = LIMITS) -> DataFrame:
    """ROUTED rows of the suffixes of docs (text, lang), sorted and counted by task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            langs = batch.column("lang_key").to_numpy().view(_U)
            for block in blocks(batch.column("text")):
                w = words(block, langs[block.first : block.first + len(block)])
                columns, inside = [w.keys], np.ones(len(w.keys), bool)
                for k in range(1, most):
                    inside = inside & np.append(w.follows[k - 1 :], np.zeros(min(k - 1, len(w.keys)), bool))[: len(w.keys)]
                    columns.append(np.where(inside, np.append(w.keys[k:], np.zeros(min(k, len(w.keys)), _U)), _U(0)))
                held.append(columns)
                size += len(w.keys)
                if size > limits.suffixes:
                    for kind, some in _routes([np.concatenate(c) for c in zip(*held, strict=True)], shared.value):
                        yield _sorted_rows(kind, some, buckets)
                    held, size = [], 0
        if size:
            for kind, some in _routes([np.concatenate(c) for c in zip(*held, strict=True)], shared.value):
                yield _sorted_rows(kind, some, buckets)

    return _texts(docs).mapInArrow(run, ROUTED)


def frequent_phrases(parts: DataFrame, most: int, least: int) -> DataFrame:
    """FOUND: phrases of 2 to `most` words that occur `least` times or more, from ROUTED rows."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        columns = [np.concatenate(c) for c in zip(*(_unrouted(r, most) for r in table.column("levels")), strict=True)]
        weight = columns.pop()
        digit = (columns[0] >> _U(48)).astype(np.uint16)  # the first split of the first word, by its high bits
        pointers = np.argsort(digit, kind="stable")
        digit = digit[pointers]
        start = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
        size = np.diff(np.append(start, len(pointers)))
        words_, counts = [], []
        for depth, c in enumerate(columns):
            if depth:  # suffixes that end here go no deeper, light segments nowhere
                keep = np.repeat(total >= least, size) & (c[pointers] != 0)
                of = np.repeat(np.arange(len(size)), size)[keep]
                pointers, size = pointers[keep], np.bincount(of, minlength=len(size))
                size = size[size > 0]
                start = np.cumsum(size) - size
            if not len(pointers):
                break
            start = split(pointers, start, size, c)
            size = np.diff(np.append(start, len(pointers)))
            total = np.add.reduceat(weight[pointers], start)
            if depth >= max(kind - 1, 1):  # all suffixes with these words are here
                some = np.flatnonzero(total >= least)
                words_ += np.stack([x[pointers[start[some]]] for x in columns[: depth + 1]], 1).view(np.int64).tolist() if len(some) else []
                counts += total[some].tolist()
        return pa.table({"words": pa.array(words_, pa.list_(pa.int64())), "a": pa.array(counts, pa.int64())})

    return parts.groupBy("kind", "bucket").applyInArrow(run, FOUND)


def _parts_of(words_: Column, shortest: int, longest: Column) -> Column:
    """All contiguous parts of a phrase from `shortest` to `longest` words."""
    n = F.size(words_)
    sizes = F.when(longest >= shortest, F.sequence(F.lit(shortest), longest)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice(words_, i, m))))


def scored(found: DataFrame, counted: DataFrame, inside: int = 50) -> DataFrame:
    """(words, a, l, r, score) of the phrases that stay: found (FOUND) and counted (COUNTED) hold all counts of phrases and words.
    A phrase goes when a longer one that holds it has `inside` hundredths of its occurrences."""
    w = F.col("words")
    counts = found.select(w, F.col("a").alias("f")).unionByName(counted.where("key <> 0").select(F.array("key").alias("words"), F.col("n").alias("f")))
    counts = broadcast_if_small(written(counts, "phrase-counts"), LOOKUP_ROWS)
    cuts = found.select(w, "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice(w, F.lit(1), F.col("k"))).withColumn("right", F.slice(w, F.col("k") + 1, F.size(w) - F.col("k")))
    for side in ("l", "r"):
        part = "left" if side == "l" else "right"
        cuts = cuts.join(counts.select(F.col("words").alias(part), F.col("f").alias(side)), part)
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("_up", (whole("a") * whole("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_down", whole("l") * whole("r"))
    best = cuts.withColumn("score", F.expr("CAST(_up AS decimal(38,0)) div CAST(_down AS decimal(38,0))")).groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = found.where(F.size(w) > 2).select(F.explode(_parts_of(w, 2, F.size(w) - 1)).alias("words"), F.col("a").alias("held"))
    longer = longer.groupBy("words").agg(F.max("held").alias("held"))
    kept = best.join(longer, "words", "left").where(F.col("held").isNull() | (100 * F.col("held") < inside * F.col("a")))
    return kept.select("words", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, inside: int = 50, limits: Limits = LIMITS) -> DataFrame:
    """SCORED rows of docs (text, lang): of each language the `top` phrases of 2 to `most` words by score, then count, then text."""
    counted = word_counts(docs, least, limits)
    totals = counted.where("key = 0").select("lang", "n")  # one row a language
    total = int(totals.agg(F.sum("n")).first()[0] or 0)
    bound = max(limits.frequent, total // FREQUENT)
    frequent = np.sort(counted.where((F.col("key") != 0) & (F.col("n") > bound)).select("key").toPandas()["key"].to_numpy(np.int64).view(_U))
    buckets = max(1, total // limits.bucket)
    found = written(frequent_phrases(routed(docs, most, frequent, buckets, limits), most, least), "phrases")
    kept = scored(found, counted, inside)
    names = counted.where("key <> 0").select("lang", "key", "word")
    names = broadcast_if_small(names, LOOKUP_ROWS)
    for i in range(most):
        name = names.select(F.col("key").alias(f"_k{i}"), F.col("word").alias(f"_w{i}"), *(["lang"] if i == 0 else []))
        kept = kept.withColumn(f"_k{i}", F.get("words", F.lit(i))).join(name, f"_k{i}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *(f"_w{i}" for i in range(most))))
    return ranked(kept, totals, top)


def ranked(kept: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """SCORED rows. Phrases are dealt out by range of (lang, score, count, text), so that no task ranks a language alone: a rank is the place in its
    task, less where the language starts there, and what tasks before it hold of the language."""
    order = [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = written(kept.select("lang", "phrase", "a", "l", "r", "score"), "phrases-scored")
    kept = kept.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    kept = written(kept.withColumn("_task", F.shiftrightunsigned("_place", 33)), "phrases-ordered")
    own = kept.groupBy("lang", "_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))  # a row a task and one a language
    own = own.withColumn("_base", F.sum("_n").over(Window.partitionBy("lang").orderBy("_task")) - F.col("_n"))
    out = kept.join(broadcast_if_small(own.drop("_n"), LOOKUP_ROWS), ["lang", "_task"])
    out = out.withColumn("rank", F.col("_base") + F.col("_place") - F.col("_first") + 1).where(F.col("rank") <= top)
    return out.join(totals, "lang").select(*SCORED)
