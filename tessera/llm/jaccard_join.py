"""N-gram Jaccard join: texts whose sets of word n-grams are alike, and the classes they form.

Universe-partition pigeonhole. n-grams are hashed, and the hash range is cut into cells; a pair with
Jaccard >= t whose larger set lies in a size band differs in at most H n-grams, so among H + 1 + e cells at
least e + 1 hold the same n-grams in both sets. The index has one key per cell subset. A plan per band,
chosen by cost from the number of distinct sets in it, sets e, the number of nearly empty cells a set may leave out
of the index (they would meet many unrelated sets), or turns to half as many cells with
one-deletion neighbourhoods, whose keys also meet across one differing n-gram.

Keys travel in columns, one row per task and bucket of keys; a task names its own sets that meet under a key at once and
hands on two of them, so a frequent key stays small. Sets that share a key are compared with hubs first (the member found
under most keys), so a large group of copies costs one comparison per member. Only pairs that hubs leave in
different classes are then compared. A pair goes by its sizes and parity sketches first, of 512 bits or as many as a set has n-grams;
n-grams are fetched for the pairs that these do not prove too far apart, and every link is an exact Jaccard. No candidate is dropped or capped, so no link
between different sets is lost to the classes.

Equal sets are joined by their 64-bit hash before the join, so exact copies take part once.

Defined results: a text with fewer words than n has its whole word sequence as its one n-gram; null, empty
and blank texts have an empty set and are linked with nothing; a row with a null doc_id takes part like others, but cannot name a
class: the class of such rows alone is null; repeated rows are equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, give_back, mix, packed, shingles, unpacked, words
from tessera.llm.components import components
from tessera.llm.shared import doc_key, doc_tie, looked_up, unused, written

_U = np.uint64
LIGHT = 2  # a cell with fewer n-grams is nearly empty
HUB_ROUNDS = 3
SKETCH = 8  # longs of the shortest sketch
SEEN = 1_000_000  # sets a task remembers, so as to index equal sets once
HELD = 500_000  # keys a task holds before it hands them on
BUCKET = 2_000_000  # keys meant for one bucket; in large buckets a set names itself once for more of its keys
PART = 500_000  # keys of a bucket that are looked at together
KEY_BYTES = 5  # of a key within its bucket; sets that meet by chance are told apart later
KEYS = "kind int, bucket long, size int, keys binary, ids binary, runs binary"
_TOP = 1 << 40
_KEY = _U((1 << 8 * KEY_BYTES) - 1)


@dataclass(frozen=True)
class Likeness:
    """Jaccard >= num / den over n-grams of n words."""

    n: int
    num: int
    den: int

    def most_apart(self, sizes: int) -> int:
        """Largest symmetric difference of a pair whose sizes sum to this."""
        return sizes * (self.den - self.num) // (self.den + self.num)


def _band_edges() -> list[int]:
    edges = [1]
    while edges[-1] < _TOP:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


EDGES = _band_edges()


@dataclass(frozen=True)
class Plan:
    cells: int
    spare: int  # nearly empty cells a set may leave out
    deletions: bool


def plan_band(band: int, like: Likeness, sets: int) -> Plan:
    """The cheapest plan: keys per set plus unrelated sets met under keys of nearly empty cells."""
    least = max(1, EDGES[band] * like.num // like.den)
    apart = like.most_apart(2 * (EDGES[band + 1] - 1))
    poisson = lambda mean, most: sum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(most + 1))
    best = None
    for spare in sorted({0, 1, 2, 3, 4, *(apart * x // 20 for x in range(1, 11))}):
        cells = apart + 1 + spare
        light = poisson(least / cells, LIGHT - 1)
        over = 1 - poisson(cells * light, spare) if cells * light < 500 else float(cells * light > spare)
        cost = cells + sets * cells * light * max(over, 0.0)
        if best is None or cost < best[0]:
            best = cost, Plan(cells, spare, False)
    cells = apart // 2 + 1
    cost = cells + EDGES[band + 1] + sets * cells * poisson(least / cells, 1)
    return Plan(cells, 0, True) if cost < best[0] else best[1]


def bands_of(n: int, like: Likeness) -> range:
    """The bands of sets that may be the larger partner of one of size n, its own included."""
    return range(bisect.bisect_right(EDGES, n) - 1, bisect.bisect_right(EDGES, n * like.den // like.num))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted set of n-gram hashes of each text of a block)."""
    for block in blocks(column):
        h, off = shingles(words(block, lower=True), n)
        yield block.first, [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def _set_id(s: np.ndarray) -> int | None:
    return int(mix(np.array([mix(s ^ _U(0x7F4A7C15)).sum(dtype=np.uint64) + _U(len(s))])).view(np.int64)[0]) if len(s) else None


def cell_keys(s: np.ndarray, band: int, plan: Plan) -> np.ndarray:
    """The index keys of a set under the plan of a band."""
    m = plan.cells
    cell = ((s >> _U(32)) * _U(m)) >> _U(32)
    count = np.bincount(cell.astype(np.int64), minlength=m)
    value = mix(s ^ _U(0x1B873593))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    end = np.cumsum(count)
    content = total[end] - total[end - count]
    place = mix(np.arange(m, dtype=np.uint64) + _U(band << 44))
    if plan.deletions:
        less = content[cell.astype(np.int64)] - value
        return mix(np.concatenate([content + place, less + place[cell.astype(np.int64)]]))
    light = count < LIGHT
    return mix((content + place)[~light] if light.sum() <= plan.spare else content + place)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", doc_key(F.col("doc_id")).alias("doc"), doc_tie(F.col("doc_id"), F.col("text")).alias("tie"), "text")


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set by the low bits of its hashes: a power of two of bits, as many as it has n-grams. A sketch of
    half the length is the sum of its halves."""
    longs = SKETCH
    while 64 * longs < len(s):
        longs *= 2
    ones = np.bincount((s & _U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.uint64)


def set_table(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, doc, tie, n, set_id, sketch) of every row; set_id is null for an empty set."""

    def run(batches):
        for batch in batches:
            for first, sets in _sets(batch.column("text"), like.n):
                own = [batch.column(c).slice(first, len(sets)) for c in ("doc_id", "doc", "tie")]
                sketch = [_sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) for s in sets], pa.int64()), _lists(np.concatenate(sketch), np.append(0, np.cumsum([len(x) for x in sketch])))], ["doc_id", "doc", "tie", "n", "set_id", "sketch"])

    return _keyed(docs).mapInArrow(run, "doc_id long, doc long, tie long, n long, set_id long, sketch array<long>")


def _name(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The name of a key of a bucket."""
    return mix(key + mix(bucket.astype(np.uint64)))


def _key_rows(keys: list[np.ndarray], ids: list[int], buckets: int, own: int) -> Iterator[pa.RecordBatch]:
    """KEYS rows of the keys of sets: kind 1, sets that meet here; kind 0, at most two sets of each key, by bucket."""
    key = np.concatenate(keys)
    of = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    by = np.lexsort((of, key))
    key, of = key[by], of[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    shared = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
    ids_ = np.array(ids, np.int64)
    bucket = ((key >> _U(32)) * _U(buckets)) >> _U(32)
    key = mix(key) & _KEY
    rows = [(1, own, int(shared.sum()), packed(_name(key, bucket)[shared], 8), packed(ids_[of[shared]], 8), b"")] if shared.any() else []
    few = rank < 2
    key, of, bucket = key[few], of[few], bucket[few]
    by = np.lexsort((of, bucket))
    key, of, bucket = key[by], of[by], bucket[by]
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        run = np.flatnonzero(np.append(True, of[a + 1 : b] != of[a : b - 1]))
        rows.append((0, int(bucket[a]), b - a, packed(key[a:b], KEY_BYTES), packed(ids_[of[a:b][run]], 8), packed(np.diff(np.append(run, b - a)).astype(np.int32), 4)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in KEYS.split(", ")])


def keys_table(docs: DataFrame, like: Likeness, plans: dict[int, Plan], buckets: int) -> DataFrame:
    """KEYS rows: the index. plans are for bands that hold sets; other bands have no partner."""

    def run(batches):
        seen: set[int] = set()
        keys, ids, size, own = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for _, sets in _sets(batch.column("text"), like.n):
                for s in sets:
                    i = _set_id(s)
                    if i is None or i in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(i)
                    made = [cell_keys(s, band, plans[band]) for band in bands_of(len(s), like) if band in plans]
                    if made:
                        keys.append(np.unique(np.concatenate(made)))
                        ids.append(i)
                        size += len(keys[-1])
                    if size > HELD:
                        yield from _key_rows(keys, ids, buckets, own)
                        keys, ids, size = [], [], 0
        if keys:
            yield from _key_rows(keys, ids, buckets, own)

    return docs.select("text").mapInArrow(run, KEYS)


def met_sets(index: DataFrame) -> DataFrame:
    """(key, set_id) of the keys that two sets or more share."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        give_back()
        sizes = table.column("size").to_pylist()
        parts = sum(sizes) // PART + 1
        return pa.concat_tables([part(kind, bucket, table, sizes, p, parts) for p in range(parts)])

    def part(kind: int, bucket: int, table: pa.Table, sizes: list[int], p: int, parts: int) -> pa.Table:
        """Of the keys that are p modulo parts."""
        names, ids = [], []
        for size, k, i, r in zip(sizes, *(table.column(c) for c in ("keys", "ids", "runs")), strict=True):
            own = unpacked(i.as_buffer(), len(i.as_buffer()) // 8, 8, np.int64)
            name = unpacked(k.as_buffer(), size, 8 if kind else KEY_BYTES, np.uint64)
            if not kind:
                own = np.repeat(own, unpacked(r.as_buffer(), len(r.as_buffer()) // 4, 4, np.int32))
            here = name % _U(parts) == _U(p)
            names.append(name[here])
            ids.append(own[here])
        name, of = np.concatenate(names), np.concatenate(ids)
        by = np.lexsort((of, name))
        name, of = name[by], of[by]
        new = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
        first = np.append(0, np.flatnonzero(new) + 1)[: len(name)]
        name, of = name[first], of[first]
        if not kind:
            same = name[1:] == name[:-1]
            met = np.append(False, same)[: len(name)] | np.append(same, False)[: len(name)]
            name, of = _name(name[met], np.array(bucket)), of[met]
        return pa.table({"key": pa.array(name.view(np.int64)), "set_id": pa.array(of)})

    return index.groupBy("kind", "bucket").applyInArrow(run, "key long, set_id long").distinct()


def token_table(docs: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """(set_id, n, grams, sketch) of the wanted sets (set_id, doc, tie), read from one row of each."""
    lists = wanted.groupBy("doc", "tie").agg(F.min("set_id").alias("set_id"))  # a row has one set

    def run(batches):
        for batch in batches:
            wants = batch.column("set_id")
            for first, sets in _sets(batch.column("text"), like.n):
                kept = [(w, s) for w, s in zip(wants.slice(first, len(sets)).to_pylist(), sets, strict=True) if len(s)]
                if kept:
                    off = np.append(0, np.cumsum([len(s) for _, s in kept]))
                    grams = np.concatenate([s for _, s in kept])
                    sketch = [_sketch(s) for _, s in kept]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.int64()), pa.array(np.diff(off)), _lists(grams, off), _lists(np.concatenate(sketch), np.append(0, np.cumsum([len(x) for x in sketch])))], ["set_id", "n", "grams", "sketch"])

    rows = looked_up(_keyed(docs), written(lists, "wanted"), ["doc", "tie"], "inner").select("set_id", "text")
    made = written(rows.mapInArrow(run, "set_id long, n long, grams array<long>, sketch array<long>"), "grams")
    if made.groupBy("set_id").count().where("count > 1").limit(1).count():
        made = made.dropDuplicates(["set_id"])  # rows that repeat id and text
    return made


def _may_link(like: Likeness, na: Column, nb: Column, a: Column, b: Column) -> Column:
    """False only where sizes or parity sketches prove a pair too far apart."""
    sizes = (like.den * na >= like.num * nb) & (like.den * nb >= like.num * na)  # from Jaccard 1/2 on lengths differ by one doubling at most; below, nothing is ruled out
    half = lambda x, y: F.when(F.size(x) <= F.size(y), x).otherwise(F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v)))
    apart = F.aggregate(F.zip_with(half(a, b), half(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, x: t + x)
    return sizes & (F.coalesce(apart, F.lit(0)) * (like.den + like.num) <= (na + nb) * (like.den - like.num))


def sieved(pairs: DataFrame, facts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of facts (set_id, n, sketch) leave."""
    side = lambda c: facts.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_may_link(like, F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"))).select("a", "b")


def verified(pairs: DataFrame, tokens: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda c: tokens.select(F.col("set_id").alias(c), F.size("grams").cast("long").alias(f"n_{c}"), F.col("grams").alias(f"g_{c}"))
    pairs = written(sieved(pairs, tokens, like), "sieved")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("g_a", "g_b")).cast("long")
    return both.withColumn("x", shared).where(like.den * F.col("x") >= like.num * (F.col("n_a") + F.col("n_b") - F.col("x"))).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("set_id"))
    out = members.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    return out.withColumn("label", F.coalesce("label", "set_id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The members (key, set_id, label) of keys that hold two classes or more."""
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return written(rows.join(keys, "key", "left_semi"), "mixed")


def linked_sets(docs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(id, label) for every set that links to another: labels are the classes of sets."""
    whole = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("n").alias("n"), F.min(F.struct("doc", "tie")).alias("at"), F.first("sketch").alias("sketch"))
    whole = written(whole.select("set_id", "n", "at.doc", "at.tie", "sketch"), "whole")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.5)).cast("int")
    per_size = {r["band"]: r["count"] for r in whole.groupBy(band.alias("band")).count().collect()}  # some dozens of rows
    about = lambda b: sum(per_size.get(x + int(math.log(EDGES[b]) / math.log(1.5)), 0) for x in (-1, 0, 1))
    plans = {b: plan_band(b, like, about(b)) for b in range(len(EDGES) - 1) if about(b)}
    keys = sum(about(b) * (p.cells + (EDGES[b] if p.deletions else 0)) for b, p in plans.items()) * 2 // 3
    members = written(met_sets(keys_table(docs, like, plans, max(1, keys // BUCKET))), "members")
    seen = members.groupBy("set_id").agg(F.count("*").alias("keys"))
    facts = written(whole.join(seen, "set_id"), "facts")
    members = members.join(seen, "set_id")

    links, labels, tried, tokens = None, None, None, None
    for k in range(HUB_ROUNDS + 1):
        open_ = _mixed(_labelled(members.select("key", "set_id", "keys"), labels)) if labels is not None else _labelled(written(members, "members"), None)
        if labels is not None and not open_.limit(1).count():
            break
        members = open_.drop("label")
        if k < HUB_ROUNDS:
            hubs = open_ if tried is None else open_.join(tried, ["key", "set_id"], "left_anti")
            hubs = hubs.groupBy("key").agg(F.max(F.struct("keys", "set_id", "label")).alias("h")).select("key", F.col("h.set_id").alias("hub"), F.col("h.label").alias("hub_label"))
            hubs = written(hubs, "hubs")
            pairs = open_.join(hubs, "key").where("label <> hub_label").select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()
            used = hubs.select("key", F.col("hub").alias("set_id"))
            tried = used if tried is None else tried.unionByName(used)
            pairs = written(sieved(pairs, facts, like), "pairs")
        else:
            pairs = written(_apart(open_, facts, like), "pairs")
        ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        ends = ends if tokens is None else ends.join(tokens.select("set_id"), "set_id", "left_anti")
        more = token_table(docs, facts.join(ends, "set_id", "left_semi"), like)
        tokens = more if tokens is None else tokens.unionByName(more)
        new = written(verified(pairs, tokens, like), "linked")
        links = new if links is None else links.unionByName(new)
        labels = written(components(links), "labels")
    return labels


def _apart(open_: DataFrame, facts: DataFrame, like: Likeness) -> DataFrame:
    """What hubs left apart: pairs under one key, of different classes, near by size and sketch."""
    rows = written(open_.join(facts.select("set_id", "n", "sketch"), "set_id").select("key", "set_id", "label", "n", "sketch"), "apart")
    x, y = rows.alias("x"), rows.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.label") != F.col("y.label"))
    near = near & _may_link(like, F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"))
    return x.join(y, near).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()


def _classed(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, doc, tie, n, label) of every row; rows of one class have one label, empty sets none."""
    sets = written(set_table(docs, like), "sets")
    labels = linked_sets(docs, sets, like).withColumnRenamed("id", "set_id")
    out = sets.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    return written(out.select("doc_id", "doc", "tie", "n", "label"), "classed")


def classes(docs: DataFrame, like: Likeness) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n, component_id): the size of the set of each row and the smallest
    doc_id that links reach, its own included."""
    rows = _classed(docs, like)
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "label", "left")
    return out.select("doc_id", "n", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, like: Likeness) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; a row without a doc_id stays only in a class
    of such rows. Rows that repeat both doc_id and text stand or go together; rows of empty sets stay; other columns pass through."""
    rows = _classed(docs, like).where("label IS NOT NULL")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "tie")).alias("f"))
    doc, tie = unused(docs, "doc", "tie")
    goes = rows.join(first, "label").where((F.col("doc") != F.col("f.doc")) | (F.col("tie") != F.col("f.tie")))
    goes = written(goes.select(F.col("doc").alias(doc), F.col("tie").alias(tie)).distinct(), "goes")
    keyed = docs.withColumn(doc, doc_key(F.col("doc_id"))).withColumn(tie, doc_tie(F.col("doc_id"), F.col("text")))
    return looked_up(keyed, goes, [doc, tie], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
