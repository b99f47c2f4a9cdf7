"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id, a number of the row), so equal texts lie side by side. A record counts the UTF-8
bytes of its text plus 1.

1. One pass over the documents writes the key and size of each record. Everything up to step 4 reads these narrow rows only.
2. Keys are drawn at random with weights of their sizes, a fixed number for each range that is wanted, and the quantiles of the sample
   become the boundaries of ranges. A boundary stands before all copies of a text, unless one text fills whole ranges: then it stands
   between copies, by doc_id, and at last between repeated rows.
3. The ranges are measured over all records. Overfull ones, and those that hold a border of two shards, are sampled and cut again, until
   they are small enough or hold one record. Shard borders are then the range ends nearest to equal shares.
4. Documents are dealt out by range, ordered, and written, one folder per shard. Slots follow from the written places and the counts per task.

The driver holds the samples (PER_RANGE for each of at most MOST_RANGES ranges, whatever the input) and the ranges' sizes.

Defined results: a null text has no bytes and counts 1, like an empty one, and keeps apart from it only by doc_id; null doc_ids come first
among copies; repeated rows are placed each; one document larger than a share fills its shard alone; fewer documents than shards leave shards empty; an
empty table gives no files and no rows; other columns are written with the document, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import mix
from tessera.llm.shared import doc_key, new_path, unused, written

_U = np.uint64
SHARDS = 16
FINE = 64  # ranges of a shard, at least
RANGE_BYTES = 128 << 20
MOST_RANGES = 65_536
PER_RANGE = 16  # sampled keys for each range that is wanted
OVERFULL = 2  # times the bytes meant for a range
AT_BORDER = 4  # parts into which a range at a border of two shards is cut
LOW = np.int64(-(1 << 63))
KEY = ("key", "doc", "tie")
DIGEST = "key long, doc long, tie long, size long"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _key(text: Column, doc_id: Column) -> list[Column]:
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), doc_key(doc_id).alias("doc"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")]


@dataclass
class Ranges:
    """Boundaries in ascending order, as three columns of longs; range r holds the keys from boundary r - 1 to below boundary r."""

    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def of(self, *keys: np.ndarray) -> np.ndarray:
        """The range of each key: how many boundaries are no greater."""
        out = np.zeros(len(keys[0]), np.int64)
        self._rank(keys, 0, np.arange(len(out)), 0, len(self.bounds), out)
        return out

    def _rank(self, keys: tuple[np.ndarray, ...], column: int, rows: np.ndarray, low: int, high: int, out: np.ndarray) -> None:
        own, value = self.bounds[low:high, column], keys[column][rows]
        left, right = np.searchsorted(own, value, "left"), np.searchsorted(own, value, "right")
        out[rows] = low + right
        if column < 2:
            same = right > left  # the next column decides
            for at in np.unique(left[same]):
                some = same & (left == at)
                self._rank(keys, column + 1, rows[some], low + int(at), low + int(right[some][0]), out)


def sampled(digests: DataFrame, ranges: Ranges, goal: np.ndarray, turn: int) -> pd.DataFrame:
    """Keys drawn with weights of their sizes, with how often each is drawn: about PER_RANGE for each `goal` bytes of a range; none where goal is 0."""
    shared = digests.sparkSession.sparkContext.broadcast((ranges, goal))

    def run(batches):
        ranges, goal = shared.value
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*KEY, "size")]
            at = ranges.of(*columns[:3])
            some = np.flatnonzero(goal[at] > 0)
            columns, at = [c[some] for c in columns], at[some]
            luck = (mix(columns[2].view(_U) + _U(turn + 1)) >> _U(11)).astype(np.float64) / (1 << 53)
            hits = np.floor(columns[3] * (PER_RANGE / goal[at]) + luck).astype(np.int64)
            drawn = np.flatnonzero(hits > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[drawn]) for c in (*columns[:3], hits, at)], [*KEY, "hits", "range"])

    return digests.mapInArrow(run, "key long, doc long, tie long, hits long, range long").toPandas().sort_values([*KEY])


def measured(digests: DataFrame, ranges: Ranges) -> pd.DataFrame:
    """bytes and largest record of every range, by range."""
    shared = digests.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        ranges = shared.value
        size, largest = np.zeros(len(ranges), np.int64), np.zeros(len(ranges), np.int64)
        for batch in batches:
            at, own = ranges.of(*(batch.column(c).to_numpy() for c in KEY)), batch.column("size").to_numpy()
            np.add.at(size, at, own)
            np.maximum.at(largest, at, own)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(largest[some])], ["range", "bytes", "largest"])

    sums = digests.mapInArrow(run, "range long, bytes long, largest long").groupBy("range").agg(F.sum("bytes").alias("bytes"), F.max("largest").alias("largest")).toPandas()
    return sums.set_index("range").reindex(range(len(ranges)), fill_value=0)


def cut(ranges: Ranges, goal: np.ndarray, size: np.ndarray, sample: pd.DataFrame) -> Ranges:
    """The ranges with those whose goal is above 0 cut at quantiles of their sampled keys."""
    made = [tuple(b) for b in ranges.bounds.tolist()]
    for at, own in sample.groupby("range"):
        parts = int(np.ceil(size[at] / goal[at]))
        upto, keys = own["hits"].cumsum().to_numpy(), own[[*KEY]].to_numpy(np.int64)
        last = tuple(ranges.bounds[at - 1].tolist()) if at else (int(LOW),) * 3
        end = tuple(ranges.bounds[at].tolist()) if at < len(ranges.bounds) else None
        for part in range(1, parts):
            key, doc, tie = keys[np.searchsorted(upto, upto[-1] * part / parts, "left")].tolist()
            for bound in ((key, int(LOW), int(LOW)), (key, doc, tie), (key, doc, tie + 1)):  # before all copies; before the row; behind it
                if bound > last and bound[2] < 1 << 63:
                    if end is None or bound < end:
                        made.append(bound)
                        last = bound
                    break
    return Ranges(np.array(sorted(set(made)), np.int64).reshape(-1, 3))


@dataclass
class Plan:
    """Ranges, and of each range its bytes and its shard."""

    ranges: Ranges
    bytes: np.ndarray
    shard: np.ndarray

    def tasks(self, n: int) -> np.ndarray:
        """Which of n tasks writes each range: neighbours together, of near equal bytes."""
        middle = np.cumsum(self.bytes) - self.bytes / 2
        return np.minimum(middle * n / max(self.bytes.sum(), 1), n - 1).astype(np.int64)


def plan(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, range_bytes: int = RANGE_BYTES) -> Plan:
    """The ranges of docs (doc_id, text) and their shards."""
    digests = written(docs.select(*_key(F.col("text"), F.col("doc_id")), size_of(F.col("text")).alias("size")), "shard-keys")
    total = digests.agg(F.sum("size")).first()[0] or 0
    want = int(min(max(total // range_bytes, shards * fine), MOST_RANGES))
    target = max(total / want, 1.0)
    ranges, turn = Ranges(np.zeros((0, 3), np.int64)), 0
    size, goal = np.array([total], np.int64), np.array([target])
    borders = total * np.arange(1, shards) / shards
    while goal.any() and total:
        more = cut(ranges, goal, size, sampled(digests, ranges, goal, turn))
        if len(more) == len(ranges):
            break
        ranges, turn = more, turn + 1
        found = measured(digests, ranges)
        size, several = found["bytes"].to_numpy(np.int64), (found["bytes"] > found["largest"]).to_numpy()
        goal = np.where(several & (size > OVERFULL * target), target, 0.0)
        split = np.minimum(np.searchsorted(np.cumsum(size), borders, "right"), len(size) - 1)
        split = split[several[split] & (size[split] > OVERFULL * target / AT_BORDER)]
        goal[split] = target / AT_BORDER
    middle = np.cumsum(size) - size / 2
    return Plan(ranges, size, np.searchsorted(borders, middle, "right"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, made: Plan | None = None) -> None:
    """docs (doc_id, text and any others) as Parquet files, one folder per shard, each row with its place."""
    made = made or plan(docs.select("doc_id", "text"), shards)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.sparkSession.sparkContext.broadcast((made.ranges, made.shard, made.tasks(n)))

    @F.pandas_udf("struct<task:int,shard:int,range:int>")
    def placed(key: pd.Series, doc: pd.Series, tie: pd.Series) -> pd.DataFrame:
        ranges, shard, task = shared.value
        at = ranges.of(key.to_numpy(), doc.to_numpy(), tie.to_numpy())
        return pd.DataFrame({"task": task[at], "shard": shard[at], "range": at})

    at, key, shard, place = unused(docs, "at", "key", "shard", "place")
    rows = docs.withColumn(key, F.struct(*_key(F.col("text"), F.col("doc_id"))))
    rows = rows.withColumn(at, placed(*(F.col(f"{key}.{c}") for c in KEY)))
    rows = rows.repartitionById(n, F.col(f"{at}.task")).withColumn(shard, F.col(f"{at}.shard"))
    rows = rows.sortWithinPartitions(shard, f"{at}.range", *(f"{key}.{c}" for c in KEY)).withColumn(place, F.monotonically_increasing_id())
    rows.drop(at, key).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of write_shards, whose docs had this schema, with shard and slot (their place in the shard, gapless from 0)."""
    empty = spark.createDataFrame([], schema)
    shard, place = unused(empty, "shard", "place")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(place, T.LongType()), T.StructField(shard, T.IntegerType())])).parquet(path)
    task = F.shiftrightunsigned(place, 33)  # places grow from task to task, by one from row to row
    own, first, base = unused(rows, "task", "first", "base")
    counts = rows.groupBy(shard, task.alias(own)).agg(F.count("*").alias("n"), F.min(place).alias(first))
    counts = counts.select(F.col(shard), own, first, (F.sum("n").over(Window.partitionBy(shard).orderBy(own)) - F.col("n")).alias(base))  # a row per task and shard
    out = rows.withColumn(own, task).join(F.broadcast(counts), [shard, own])
    keep = [F.col(f"`{c}`") for c in schema.names if c.lower() not in ("shard", "slot")]
    return out.select(*keep, F.col(shard).alias("shard"), (F.col(base) + F.col(place) - F.col(first)).alias("slot"))


def shard_files(docs: DataFrame, shards: int = SHARDS) -> str:
    """Write docs below the shared folder; the path."""
    path = new_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards)
    return path
