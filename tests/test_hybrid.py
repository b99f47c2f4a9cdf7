"""Scoped lexical search and hybrid retrieval on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import hybrid as H
from tessera.operators import lexical as L
from tessera.operators import retrieval as D

CHUNKS = "chunk_id long, doc_id long, idx int, page int, name string, text string"
ROWS = [
    (101, 10, 0, 1, "nds.txt", "Ставка НДС составляет 20 процентов для операций."),
    (102, 10, 1, 2, "nds.txt", "Общие положения без конкретной ставки."),
    (103, 11, 0, 1, "profit 2021.txt", "Ставка налога на прибыль описана отдельно."),
    (104, 12, 0, 1, "code 2024.txt", "Моддаи 91. Ставка определяется законом."),
    (105, 12, 1, 1, "code 2024.txt", "   "),
    (106, 13, 0, 1, "code.txt", "Статья 910 про другое, ставка иная."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNKS)


@pytest.fixture(scope="module")
def index(chunks):
    return L.LexicalIndex.build(chunks)


@pytest.fixture(scope="module")
def scope(spark):
    return spark.createDataFrame([("ten", 10), ("both", 10), ("both", 11)], "scope string, doc_id long")


def search(spark, index, chunks, rows, scope, top=5):
    found = L.lexical_search(index, chunks, spark.createDataFrame(rows, "qid long, scope string, text string"), top, scope)
    return {q: [(r.chunk_id, r.score) for r in sorted(found.where(F.col("qid") == q).collect(), key=lambda r: r["rank"])] for q in {x[0] for x in rows}}


def test_scope_and_statistics(spark, index, chunks, scope):
    ask = "какая ставка ндс 20 процентов"
    out = search(spark, index, chunks, [(1, "ten", ask), (2, "none", ask), (3, None, ask), (4, "both", ask), (5, "ten", "и на по")], scope)
    assert [c for c, _ in out[1]] == [101] and out[2] == [] and out[5] == []
    assert out[3][0][0] == 101 and out[4][0][0] == 101
    assert len({out[1][0][1], out[3][0][1], out[4][0][1]}) == 3  # n, df and mean length are those of the scope


def test_score_by_hand(spark, scope):
    chunks = spark.createDataFrame([(1, 10, 0, 1, "a", "ab cd cd"), (2, 10, 1, 1, "a", "ab"), (3, 11, 0, 1, "a", "xy xy xy xy")], CHUNKS)
    out = search(spark, L.LexicalIndex.build(chunks), chunks, [(1, "ten", "cd zz")], scope)
    tf = 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))
    assert out[1] == [(1, round(math.log(1 + (2 - 1 + 0.5) / (1 + 0.5)) * tf, 6))]


def test_bonuses_and_variants(spark, index, chunks, scope):
    asked = [(1, "ставка"), (2, "ставка"), (2, "ставка 2021"), (3, "ставка"), (3, "статья 91"), (4, "ставка налога на прибыль")]
    found = search(spark, index, chunks, [(q, None, t) for q, t in asked], None)
    plain, year, article, phrase = (dict(found[q]) for q in (1, 2, 3, 4))
    assert set(plain) == {101, 102, 103, 104, 106}
    assert year[103] - plain[103] == pytest.approx(0.3, abs=1e-4) and year[101] == pytest.approx(plain[101], abs=1e-6)
    assert article[104] > plain[104] + 0.35 - 1e-6  # the other language's form
    assert max(phrase, key=phrase.get) == 103


def test_cut_rows_come_back_with_a_bonus(spark):
    """Top-1 by score alone is another chunk than with the bonus: pruning must keep both."""
    rows = [(1, 1, 0, 1, "a", "omega alpha beta"), (2, 2, 0, 1, "2020", "omega alpha beta gamma")] + [(10 + i, 10 + i, 0, 1, "b", "beta gamma delta") for i in range(3)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    out = search(spark, L.LexicalIndex.build(chunks), chunks, [(1, None, "omega 2020")], None, top=1)
    assert [c for c, _ in out[1]] == [2]


def test_knn_within_a_scope(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, v array<double>")
    queries = spark.createDataFrame([(1, [0.0, 0.0], None), (2, [0.0, 0.0], "odd"), (3, [9.0, 0.0], "none"), (4, None, None)], "qid long, q array<double>, scope string")
    scope = spark.createDataFrame([("odd", i) for i in (1, 3, 5)] + [("late", 9)], "scope string, id long")
    out = D.knn_search(vectors, queries, 2, scope=scope).collect()
    assert sorted((r.qid, r["rank"], r.id) for r in out) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 3)]


def test_hybrid_stages(spark, index, chunks, scope):
    vectors = spark.createDataFrame([(101, [1.0, 0.0]), (103, [0.9, 0.1]), (104, [0.0, 1.0]), (105, [1.0, 0.0]), (999, [1.0, 0.0])], "id long, v array<double>")
    questions = spark.createDataFrame([(1, None, "ставка НДС", [1.0, 0.0]), (2, "ten", "ставка НДС", [0.0, 1.0]), (3, "none", "ставка", [1.0, 0.0]), (4, None, "qqqq", [0.0, 9.0]), (5, None, "что в статье 91", [1.0, 0.0])], "qid long, scope string, text string, v array<double>")
    out = H.retrieve(questions, [F.lower("text")], chunks, vectors, index, scope, top=3, threshold=1.5)
    vector = {(r.qid, r.chunk_id): r for r in out.vector.collect()}
    assert not {c for _, c in vector} & {105, 999}  # no text; gone
    assert {c for q, c in vector if q == 2} == {101} and not [q for q, _ in vector if q == 3]
    assert vector[5, 104]["rank"] == 1 and vector[5, 104].distance == pytest.approx(1.0)  # first, at half its distance of 2
    fused = {(r.qid, r.chunk_id): r for r in out.fused.collect()}
    assert fused[1, 101].method == "lexical+vector" and fused[1, 101]["rank"] == 1
    final = {}
    for r in sorted(out.final.collect(), key=lambda r: (r.qid, r["rank"])):
        final.setdefault(r.qid, []).append((r.chunk_id, r.method))
    assert final[1][0] == (101, "lexical+vector") and len(final[1]) == 3 and 3 not in final
    assert {c for c, _ in final[2]} <= {101, 102} and {m for _, m in final[4]} <= {"vector"}
    scores = spark.createDataFrame([(1, 103, 9.0), (1, 101, 1.0)], "qid long, id long, score double")
    again = H.retrieve(questions.where("qid = 1"), [F.lower("text")], chunks, vectors, index, scope, scores, top=2).final.collect()
    assert [r.chunk_id for r in sorted(again, key=lambda r: r["rank"])] == [103, 101]


def test_fallback_and_year(spark, index, chunks):
    vectors = spark.createDataFrame([(101, [1.0]), (103, [0.0]), (104, [3.0])], "id long, v array<double>")
    far = spark.createDataFrame([(1, None, "in 2024", [2.0]), (2, None, "in 1999", [2.0])], "qid long, scope string, text string, v array<double>")
    found = H.targeted_by_year(far, chunks, vectors, None, 5).collect()
    assert [(r.qid, r.id, r.score) for r in found] == [(1, 104, 0.5)]
