"""Shared-folder tables and size-checked broadcasts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
LOOKUP_BYTES = 32 << 20  # largest table of lists that is broadcast to the rows of documents


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")  # one machine: any folder is shared
        spark.conf.set(CHECKPOINT_KEY, folder)
    if not folder:
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on a batch of rows that goes to Python has about BATCH_BYTES, or one row: both sides of it hold a batch in several copies."""
    if int(spark.conf.get(BATCH_KEY, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here, and what
    was computed survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count shows at most max_rows rows; else leave a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def doc_key(doc_id: Column) -> Column:
    """A long that is never null and orders as doc_id does, nulls first."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def doc_tie(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id by their text, and a null doc_id from the least long."""
    return F.xxhash64(doc_id.isNull(), text)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have = {c.lower() for c in df.columns}
    return [next(x for k in range(len(have) + 1) if (x := f"_{n}{k or ''}").lower() not in have) for n in names]


def looked_up(rows: DataFrame, lists: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with lists, one of each key, by keys that are never null. Lists are broadcast when their measured size allows;
    else both sides are shuffled, and rows, which may hold long texts, are not sorted."""
    arrays = [f.name for f in lists.schema.fields if isinstance(f.dataType, T.ArrayType)]
    size = F.lit(16 * len(lists.columns))
    for name in arrays:
        size = size + 8 * F.size(name)
    total = lists.agg(F.sum(size.cast("long"))).first()[0] or 0
    return rows.join(F.broadcast(lists) if total <= LOOKUP_BYTES else lists.hint("shuffle_hash"), keys, how)
