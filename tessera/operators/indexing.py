"""A chunk index that is rebuilt whole or follows arriving documents.

The index is a folder in the shared store:

    base-<n>/{chunks,documents}    a snapshot of all documents
    log/{chunks,documents}/batch=<k>    what micro-batch k brought
    manifest/    one row per published snapshot: its folder, and the batches that it holds

A batch never rewrites what stands. Of each document the row with the greatest (version, batch) counts, and its chunks are those of that
batch; a row of a deleted document is its tombstone. A batch that is repeated overwrites its own folders, so it changes nothing. Readers go by the newest
manifest row, which is written after its snapshot, so a rebuild that fails half way leaves the index as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.sources.tables import saved

CHUNKS = "doc_id long, version long, batch long, chunk_index int, text string, page_start int, page_end int, section_path array<string>, embedding_text string"
DOCUMENTS = "doc_id long, version long, batch long, status string, error string, language string, n_chunks int"
MANIFEST = "n long, base string, upto long"
NO_TEXT = "no text could be extracted"
SAMPLE = 5  # chunks that decide the language


def indexed(docs: DataFrame, blocks: DataFrame, batch: int, packed: Callable[[pd.DataFrame], pd.DataFrame] = C.pack) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, name, version, deleted) and blocks (doc_id, page, ord, text) to the CHUNKS and DOCUMENTS rows of a batch.

    Of several rows of a document in a batch the newest version counts. A document without text, or one that raises, gets the status "error" and no
    chunks; the others go on. Paths are redacted from what is reported. Rows without a doc_id name no document and are left out."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("version"), F.desc("deleted"), F.xxhash64("name"))
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "name", F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    docs = docs.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    made = saved(C.chunk_or_error(blocks.join(docs.where("NOT deleted").select("doc_id"), "doc_id", "left_semi"), packed), "chunked")
    good = made.where("error IS NULL").join(docs, "doc_id")
    embedding = T.build_embedding_text(F.col("name"), F.col("section_path"), F.col("page_start"), F.col("text"))
    chunks = good.select("doc_id", "version", F.lit(batch).cast("long").alias("batch"), "chunk_index", "text", "page_start", "page_end", "section_path", embedding.alias("embedding_text"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_index") < SAMPLE, F.struct("chunk_index", "text")))), lambda x: x["text"]), " ")  # at most SAMPLE chunks a document
    per = made.groupBy("doc_id").agg(F.count("chunk_index").cast("int").alias("n_chunks"), F.max("error").alias("error"), T.detect_language(said).alias("language"))
    state = docs.join(per, "doc_id", "left")
    error = F.when(F.col("deleted"), None).when(F.col("error").isNotNull(), T.redact_paths(F.col("error"))).when(F.coalesce("n_chunks", F.lit(0)) == 0, NO_TEXT)
    state = state.withColumn("error", error)
    status = F.when(F.col("deleted"), "deleted").when(F.col("error").isNotNull(), "error").otherwise("indexed")
    return chunks, state.select("doc_id", "version", F.lit(batch).cast("long").alias("batch"), status.alias("status"), "error", F.when(status == "indexed", F.col("language")).alias("language"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


class ChunkIndex:
    """The index in one folder, for one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows below a folder; none before its first write."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _newest(self) -> tuple[int, str | None, int]:
        row = self._read("manifest", MANIFEST).agg(F.max(F.struct("n", "base", "upto")).alias("m")).first()["m"]
        return (row["n"], row["base"], row["upto"]) if row else (0, None, -1)

    def _publish(self, chunks: DataFrame, documents: DataFrame, upto: int) -> None:
        n, _, _ = self._newest()
        base = f"base-{n + 1}-{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.path}/{base}/chunks")
        documents.write.parquet(f"{self.path}/{base}/documents")
        self.spark.createDataFrame([(n + 1, base, upto)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def rebuild(self, docs: DataFrame, blocks: DataFrame, packed: Callable[[pd.DataFrame], pd.DataFrame] = C.pack) -> DataFrame:
        """A new snapshot of docs alone: chunks of before are gone, also those of documents that fail now. One row of counts."""
        upto = self._read("log/documents", f"{DOCUMENTS}").agg(F.max("batch")).first()[0]
        upto = -1 if upto is None else upto
        self._publish(*indexed(docs, blocks, upto, packed), upto)
        now = self.documents()
        failed = F.count_if(F.col("status") == "error")
        return now.agg(F.when(failed > 0, "partial").otherwise("ok").alias("status"), F.count("*").alias("documents"), failed.alias("errors"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"))

    def upsert(self, batch: int, docs: DataFrame, blocks: DataFrame, packed: Callable[[pd.DataFrame], pd.DataFrame] = C.pack) -> None:
        """Batch number `batch`: its documents replace what the index had of them, or go."""
        chunks, documents = indexed(docs, blocks, batch, packed)
        chunks.drop("batch").write.mode("overwrite").parquet(f"{self.path}/log/chunks/batch={batch}")
        documents.drop("batch").write.mode("overwrite").parquet(f"{self.path}/log/documents/batch={batch}")  # last: a batch counts once it is here

    def _all(self, kind: str, schema: str) -> DataFrame:
        _, base, upto = self._newest()
        late = self._read(f"log/{kind}", schema).where(F.col("batch") > upto)
        return late if base is None else self._read(f"{base}/{kind}", schema).unionByName(late)

    def documents(self) -> DataFrame:
        """DOCUMENTS as they are now, one row each, deleted ones included."""
        rows = self._all("documents", DOCUMENTS)
        rest = [c.split()[0] for c in DOCUMENTS.split(", ") if c.split()[0] != "doc_id"]
        newest = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("version", "batch")).alias("d"))
        return newest.select("doc_id", "d.*")

    def chunks(self) -> DataFrame:
        """CHUNKS of the documents as they are now."""
        now = self.documents().where("status = 'indexed'").select("doc_id", "version", "batch")
        return self._all("chunks", CHUNKS).join(now, ["doc_id", "version", "batch"], "left_semi")

    def compact(self) -> None:
        """Fold the log into a new snapshot; deleted documents are forgotten. Older folders stay for readers that began before."""
        upto = self._all("documents", DOCUMENTS).agg(F.max("batch")).first()[0]
        documents = saved(self.documents().where("status <> 'deleted'"), "index-documents")
        self._publish(saved(self.chunks(), "index-chunks"), documents, -1 if upto is None else upto)


def follow(stream: DataFrame, index: ChunkIndex, to_blocks: Callable[[DataFrame], DataFrame], checkpoint: str, packed: Callable[[pd.DataFrame], pd.DataFrame] = C.pack) -> None:
    """Drain a stream of documents (doc_id, name, version, deleted and what to_blocks needs) into the index, batch by batch."""

    def each(df: DataFrame, batch: int) -> None:
        rows = saved(df, "arrived")
        index.upsert(batch, rows.select("doc_id", "name", "version", "deleted"), to_blocks(rows), packed)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
