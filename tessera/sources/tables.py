"""Reading corpora and logs, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, text string, language string, topic_id string, topic string, topic_ru string, subtopic_id string, dataset_origin string, split string, word_count int, source string"
# A writer looks at the size of a row group after 100 rows, holds it whole, compresses pages in buffers outside of the heap; a reader holds a group, too.
WIDE_GROUP = 16 << 20
WIDE = {"parquet.block.size": str(WIDE_GROUP), "parquet.page.size.row.check.min": "1", "compression": "none"}
REQUIRED = ("id", "text", "language", "topic_id", "topic", "subtopic_id", "dataset_origin", "split")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")  # one machine: any folder is shared
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, by: list[str] | None = None, wide: bool = False) -> DataFrame:
    """The rows of df from a table written to the shared folder; wide rows, of megabytes, in groups of WIDE_GROUP bytes."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(WIDE if wide else {})).partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with the reason). Blank lines are skipped."""
    schema = f"{CORPUS}, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("file", F.col("_metadata.file_path"))
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    why = F.when(F.col("_broken").isNotNull(), "not JSON").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    rows = saved(rows.withColumn("why", why), "corpus-lines")
    return rows.where("why IS NULL").drop("why", "_broken"), rows.where("why IS NOT NULL").select("file", "id", "_broken", "why")


def read_raw_records(spark: SparkSession, folder: str, schema: str = CORPUS) -> DataFrame:
    """All *.jsonl of a folder as rows of schema, with file and place: rows order by (file, place), so that first-wins
    steps give the same result at every run. Lines that are no JSON have nulls; blank lines are skipped; place has gaps."""
    lines = spark.read.text(f"{folder}/*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "file", "place").select("r.*", "file", "place")


def decode_text(content: Column) -> Column:
    """UTF-8 (byte order mark allowed); else windows-1251 when most non-ASCII bytes are outside valid UTF-8 and no binary
    control character results; else null. The upper half of the code page is mapped byte by byte; 0x98 is not in it and becomes U+FFFD."""
    utf = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    upper = bytes(range(0x80, 0x100))
    as_1251 = F.translate(latin, upper.decode("latin-1"), upper.decode("cp1251", "replace"))
    odd = latin.rlike(r"[\x00-\x08\x0e-\x1f]")
    high = F.length(F.regexp_replace(latin, r"[\x00-\x7f]", ""))
    good = F.length(F.regexp_replace(latin, r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\x00-\x7f]", ""))
    return F.regexp_replace(F.coalesce(utf, F.when(~odd & (good >= 0.8 * high), as_1251)), "^﻿", "")


def ingest_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files to (path, ord, text) blocks between blank lines, and the files that are no text."""
    files = spark.read.format("binaryFile").load(path).select("path", decode_text(F.col("content")).alias("text"))
    good = files.where("text IS NOT NULL").select("path", F.posexplode(F.split("text", r"\r?\n\s*\n")).alias("ord", "text"))
    return good.where(F.trim("text") != ""), files.where("text IS NULL").select("path")


def export_csv(log: DataFrame, path: str, newest: str) -> None:
    """Newest first, every field quoted, nulls empty."""
    log.orderBy(F.desc(newest)).write.option("quoteAll", True).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
