"""Chunking in streams: whole documents in few shuffles, same results as the plain computation."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd

from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import indexing as I

BLOCKS = "doc_id long, page int, ord int, text string"


def plain_headers(rows):
    pages = defaultdict(lambda: defaultdict(list))
    for doc, page, ord_, text in rows:
        pages[doc][page].append((ord_, text))
    line = lambda t: None if t is None else re.sub(r"\s+", " ", t).strip(" ").lower()
    out = []
    for doc, of in pages.items():
        on = Counter()
        for page, blocks in of.items():
            blocks.sort(key=lambda b: b[0])
            edges = {line(t) for k, (_, t) in enumerate(blocks) if k < 2 or k >= len(blocks) - 2}
            on.update(x for x in edges if x and len(x) < 100 and page is not None)
        n = len([p for p in of if p is not None])
        gone = {x for x, k in on.items() if n >= 3 and k >= 0.6 * n} if doc is not None else set()
        out += [(doc, page, o, t) for page, blocks in of.items() for o, t in blocks if line(t) not in gone]
    return out


def test_headers_are_found_in_the_row_of_a_document(spark):
    rng = random.Random(4)
    words = ["Head", " head ", "HEAD", "foot", "foot  two", "foot two", "", " ", None, "x" * 120, "body"]
    rows = [(doc, page, o, rng.choice(words)) for doc in [None, *range(40)] for page in rng.sample([None, *range(9)], rng.randint(1, 9)) for o in range(rng.randint(1, 6))]
    made = C.drop_headers_footers(spark.createDataFrame(rows, BLOCKS).repartition(5))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain_headers(rows), key=key) and made.count() < len(rows)
    plan = C.drop_headers_footers(spark.createDataFrame(rows, BLOCKS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_documents_are_packed_across_batches_and_in_no_groups(spark):
    rng = random.Random(5)
    rows = [(doc, page, o, " ".join(rng.choices(["word", "long.", "Статья 3\n\n", "IV. Part"], k=rng.randint(0, 60)))) for doc in [None, *range(30)] for page in [None, 0, 1, 2] for o in range(rng.randint(0, 5))]
    blocks = spark.createDataFrame(rows, BLOCKS).repartition(6)
    units = C._leveled(blocks).toPandas()
    want = []
    for _, g in units.groupby("doc_id", dropna=False):
        g = g.astype({"page": object})
        want += [(None if pd.isna(r.doc_id) else int(r.doc_id), r.chunk_index, r.text) for r in C.pack(g.assign(page=g["page"].where(g["page"].notna(), None))).itertuples()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = C.chunk_corpus(blocks)
        got = [(r.doc_id, r.chunk_index, r.text) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) > 100 and sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_the_index_is_made_in_no_groups(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(I, "saved", lambda df, name, f=I.saved: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, name))[1])
    docs = spark.createDataFrame([(1, "a", 1, False, "one\n\ntwo"), (2, "b", 1, True, "gone"), (3, "c", 1, False, " ")], "doc_id long, name string, version long, deleted boolean, text string")
    blocks = docs.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("ord"), "text")
    index = I.ChunkIndex(spark, f"file://{tmp_path}/index")
    index.upsert(0, docs.drop("text"), blocks)
    assert [(r.doc_id, r.text) for r in index.chunks().collect()] == [(1, "one\n\ntwo")] and {r.doc_id: r.status for r in index.documents().collect()} == {1: "indexed", 2: "deleted", 3: "error"}
    assert plans and all("FlatMapGroups" not in p for p in plans)


def test_paragraphs_and_ends_are_those_of_the_patterns(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(" \t\n\x0b\f\r\u0085\u2028\u00a0ab\n ") for _ in range(rng.randrange(9))) for _ in range(3000)] + ["", None, "a\n\nb", " a \u2028"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = (F.split("text", r"\n\s*\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    parts = F.when(F.col("text").isNotNull(), C.paragraphs(F.col("text")))
    assert rows.where(~parts.eqNullSafe(plain[0]) | ~C.stripped(F.col("text")).eqNullSafe(plain[1])).count() == 0
