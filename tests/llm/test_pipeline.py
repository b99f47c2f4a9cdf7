"""The pipeline's stages in turn, each against a plain computation on what the stage before it kept."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm.shared import BATCH_BYTES, BATCH_KEY
from tests.llm.test_operators import SCHEMA, corpus, plain_classes, plain_leaks, plain_line_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, None if t is None else t.replace("zo ", "the ").replace("ka ", "of "), *rest) for i, t, *rest in corpus(seed=21, n=30) if i is not None and (t is None or len(t) < 5000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{path}/documents.parquet")
    items = [(0, " ".join(rows[2][1].split()[:12])), (1, "nothing like this is in any of the documents at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", items


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, path)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert out.columns == list(P.COLUMNS) and out.dtypes == docs.dtypes
        after = {r.doc_id for r in out.collect()} if "text" in out.columns else None
        if name == "line_dedup":
            want = {i: t for (_, i, _), t in plain_line_dedup(before).items()}
            assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in want.items() if t.strip()}
        if name == "ngram_jaccard":
            assert after == {d for _, d, _, c in plain_classes(before, 5, 8, 10) if d == c}
        if name == "decontaminate":
            assert after == {r[0] for r in before if not any(plain_leaks(r[1], b) for _, b in items)}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in before}
        docs = out
    assert zlib.crc32(np.zeros(1, "<u4").tobytes()) >= 0


def test_run_equals_stages_and_empty(spark, folder, tmp_path):
    path, _ = folder
    assert P.run(spark, path).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_hand_over_small_batches(spark):
    before = spark.conf.get(BATCH_KEY).rstrip("b")
    rows = spark.range(48, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    docs = rows.limit(2).select(F.lit(1).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    try:
        for stage in (P.lines, P.near_duplicates, P.pack):
            spark.conf.unset(BATCH_KEY)
            stage(spark, docs, "")
            assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 3 * BATCH_BYTES
    finally:
        spark.conf.set(BATCH_KEY, before)
