"""What the encoder remembers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import line_dedup as L
from tessera.llm import packing, queries
from tessera.llm import token_ids as T


def test_words_that_recur_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_WORDS", 3)
    texts = [f"often new{i}x other{i}y" for i in range(30)]
    enc, met = T.Encoder(T.default_path()), []
    monkeypatch.setattr(enc, "word", lambda w, f=enc.word: (met.append(w), f(w))[1])
    got = [enc.text(t) for t in texts]
    assert met.count("often") == 1 and len(enc.words) + len(enc.older) < 20
    assert got == [T.Encoder(T.default_path()).text(t) for t in texts]


def test_an_encoder_remembers_as_many_words_as_it_may(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_WORDS", 3)
    texts = [f"new{i}x other{i}y" for i in range(30)]
    few, more = T.Encoder(T.default_path()), T.Encoder(T.default_path(), 100)
    assert [few.text(t) for t in texts] == [more.text(t) for t in texts]
    assert len(few.words) + len(few.older) < 20 and len(more.words) == 60


def test_packing_alone_remembers_as_many_words_as_files_do(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "encoded", lambda docs, tokenizer=None, words=None: asked.append(words) or docs.select(F.lit(0).alias("part"), "doc_id", F.lit(0).cast("long").alias("own"), F.lit(1).cast("long").alias("n"), F.lit(b"\2\0").alias("ids")))
    monkeypatch.setattr(queries, "_table", lambda *_: spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert queries.op3_packing(spark, "").count() == 1 and asked == [T.FILE_WORDS]


def test_lines_and_words_of_a_later_round_of_line_dedup(monkeypatch):
    texts = ["a b\n\n c\n", None, "", "\n \nd", "e", "f\n\ng h i\n"]
    blocks = list(B.blocks(pa.array(texts)))
    w = B.words(blocks[0])
    monkeypatch.setattr(L.np, "repeat", None)  # nothing is done word by word
    text, number, off = L._lines(blocks[0], w)
    assert [x.tolist() for x in (text, number, off)] == [[0, 0, 3, 4, 5, 5], [0, 2, 2, 0, 0, 2], [0, 2, 3, 4, 5, 6, 9]]
    order = L.Order(w.hashes[:4], np.arange(2, 6))
    assert (order.hashes(order.values(w.hashes)) == w.hashes >> np.uint64(21)).all()
