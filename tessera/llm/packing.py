"""Packing: all token ids in one row, cut into windows of equal length.

Pass one encodes each partition, writes its ids and sums their number. A running sum over those totals, one
row per partition, places every partition; pass two cuts each document where a window ends. Every window
but the last is full, so there is no padding before it. No document is shuffled.

Defined results: a null text is empty and still has its end id; null and repeated doc_ids are rows of their own;
a long text becomes as many pieces as windows it touches; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import broadcast_if_small, new_path
from tessera.llm.token_ids import default_path, encode_column

LENGTH = 4096
PARTS = 1_000_000  # largest table of partition totals that is broadcast
ENCODED = "part int, doc_id long, own long, n long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, tokenizer: str | None = None, words: int | None = None) -> DataFrame:
    """docs (doc_id, text) as ENCODED rows, written: ids as little-endian unsigned 16-bit integers
    where they fit, 32-bit otherwise; own is their place in the partition. A worker remembers `words` words."""
    tokenizer = tokenizer or default_path()

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids in encode_column(batch.column("text"), tokenizer, words):
                n = np.array([len(x) // 4 for x in ids], np.int64)
                own = done + np.cumsum(n) - n
                done += int(n.sum())
                small = [np.frombuffer(x, "<u4") for x in ids]
                raw = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in small]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column("doc_id").slice(first, len(ids)), pa.array(own), pa.array(n), pa.array(raw, pa.binary())], ["part", "doc_id", "own", "n", "ids"])

    path = new_path(docs.sparkSession, "packing")
    docs.select("doc_id", "text").mapInArrow(run, ENCODED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ENCODED).parquet(path)


def _cut_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, at, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * n else "<u4").astype("<u4", copy=False)
                begin = 0
                while begin < n:
                    g = at + begin
                    end = min(n, begin + length - g % length)
                    rows.append((doc, begin, end - begin, n, g // length, g % length, ids[begin:end].tobytes()))
                    held += 4 * (end - begin)
                    begin = end
                    if held > 8 << 20:
                        yield _pieces(rows)
                        rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs (doc_id, text) as PIECES: the boundary records of the windows, with their ids (unsigned 32-bit). Where packing is all that
    the executors do, more words may be remembered."""
    rows = encoded(docs, tokenizer, words)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(broadcast_if_small(before, PARTS), "part").select("doc_id", (F.col("base") + F.col("own")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cut_batches(length), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window: sequence_id, length, ids, and doc_ids and offsets of its pieces. A window holds
    a bounded number of ids, so its group is bounded."""
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return one.select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"),
    )
