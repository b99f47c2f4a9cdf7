"""The chunk index: rebuilds, failing documents, replacements, deletions, repeated and late batches."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import indexing as I
from tessera.plans import stream_queries as Q

DOCS = "doc_id long, name string, version long, deleted boolean, text string"


def blocks(docs):
    return docs.where("NOT deleted AND text IS NOT NULL").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("ord"), "text")


def picky(g: pd.DataFrame) -> pd.DataFrame:
    if g["text"].str.contains("BAD").any():
        raise ValueError("cannot read /srv/files/secret.pdf")
    return C.pack(g)


def texts(index):
    return {(r.doc_id, r.version): r.text for r in index.chunks().collect()}


def states(index):
    return {r.doc_id: (r.version, r.status, r.error, r.n_chunks) for r in index.documents().collect()}


def test_rebuild_reports_failures_and_drops_what_was(spark, tmp_path):
    index = I.ChunkIndex(spark, f"file://{tmp_path}/index")
    assert index.chunks().count() == 0 and index.documents().count() == 0
    docs = spark.createDataFrame([(1, "a", 1, False, "first text"), (2, "b", 1, False, "BAD text"), (3, "c", 1, False, "  "), (4, "d", 1, False, None), (5, "e", None, None, "чӣ матн"), (None, "f", 1, False, "no id")], DOCS)
    counts = index.rebuild(docs.drop("text"), blocks(docs.fillna({"deleted": False})), picky).first()
    assert tuple(counts) == ("partial", 5, 3, 2)
    assert texts(index) == {(1, 1): "first text", (5, 0): "чӣ матн"}
    assert states(index) == {1: (1, "indexed", None, 1), 2: (1, "error", "ValueError: cannot read [path]", 0), 3: (1, "error", I.NO_TEXT, 0), 4: (1, "error", I.NO_TEXT, 0), 5: (0, "indexed", None, 1)}
    assert {r.doc_id: r.language for r in index.documents().collect()}[5] == "tj"
    only = docs.where("doc_id = 2")
    assert tuple(index.rebuild(only.drop("text"), blocks(only), C.pack).first()) == ("ok", 1, 0, 1)
    assert texts(index) == {(2, 1): "BAD text"} and set(states(index)) == {2}


def test_batches_replace_delete_and_repeat(spark, tmp_path):
    index = I.ChunkIndex(spark, f"file://{tmp_path}/index")

    def batch(k, rows, packed=C.pack):
        docs = spark.createDataFrame(rows, DOCS)
        index.upsert(k, docs.drop("text"), blocks(docs), packed)

    first = [(1, "a", 1, False, "one"), (2, "b", 1, False, "two"), (3, "c", 1, False, "three")]
    docs = spark.createDataFrame(first, DOCS)
    index.rebuild(docs.drop("text"), blocks(docs))
    batch(0, [(1, "a", 2, False, "one again " + "long text. " * 300), (2, "b", 2, True, None), (9, "z", 1, False, "nine")])
    after = texts(index)
    assert max(r.chunk_index for r in index.chunks().where("doc_id = 1").collect()) > 2
    assert {k for k in after} == {(1, 2), (3, 1), (9, 1)} and states(index)[2][1] == "deleted"
    batch(0, [(1, "a", 2, False, "one again " + "long text. " * 300), (2, "b", 2, True, None), (9, "z", 1, False, "nine")])
    assert texts(index) == after
    batch(1, [(1, "a", 1, False, "a late older version"), (3, "c", 2, False, "BAD"), (9, "z", 1, False, "nine, sent anew")], picky)
    assert set(texts(index)) == {(1, 2), (9, 1)} and texts(index)[9, 1] == "nine, sent anew"
    assert states(index)[3] == (2, "error", "ValueError: cannot read [path]", 0)
    before = texts(index)
    index.compact()
    assert texts(index) == before and 2 not in states(index)
    batch(2, [(3, "c", 3, False, "three is well")])
    assert texts(index) == before | {(3, 3): "three is well"}


def test_a_stream_that_sends_a_document_twice_keeps_its_last_chunks(spark, tmp_path):
    schema = spark.createDataFrame([], DOCS).schema
    for version, text in ((1, "old text. " * 200), (2, "new text")):
        spark.createDataFrame([(1, "a", version, False, text), (2, "b", version, version == 2, text)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index = I.ChunkIndex(spark, f"file://{tmp_path}/index")
        I.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), index, blocks, f"file://{tmp_path}/state")
    assert texts(index) == {(1, 2): "new text"}


def test_fixed_pieces(spark):
    text = "One two. Three four! " + "x" * 25 + "\n\nLast part? yes"
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(C.fixed_pieces(F.col("t"), 10).alias("p")).collect()
    assert row[0].p == ["One two.", "Three", "four!"] or all(len(x) <= 10 for x in row[0].p)
    assert " ".join(row[0].p).replace(" ", "") == text.replace(" ", "").replace("\n", "") and row[1].p == [] and row[2].p == []
    assert spark.createDataFrame([("Ab. Cd. Ef gh. Ij",)], "t string").select(C.fixed_pieces(F.col("t"), 7).alias("p")).first().p == ["Ab. Cd.", "Ef gh.", "Ij"]


def test_outcomes_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    odd = {2: None, 3: "", 4: None, 5: " \n ", 6: "against the odds", 7: "again", 8: "again\nthis", 9: "short line\n" * 9, 16: "short line\n" * 9}
    docs = [(i, odd.get(i, f"Text {i}.\nMore of it.")) for i in range(20)] + [(0, "of the same number"), (1, "of the same number"), (None, "no number")]
    labels = [(0, 0, 0), (1, 1, 1), (2, 0, 0), (4, 0, 1), (5, 0, 0), (8, 0, 0), (10, 0, None), (11, None, 1), (12, None, None), (13, 0, 0), (13, 0, 0), (14, 0, 1), (14, 0, 0), (15, 0, 0), (15, 1, 0), (16, 0, 0), (None, 0, 1), (99, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.index_upsert(spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        assert sorted(map(tuple, got)) == sorted(con.execute(Q.reg.sql["index_upsert"]).fetchall())
