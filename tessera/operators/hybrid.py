"""Hybrid retrieval for a table of questions: lexical and vector lists, fused, cut, re-ranked, rid of repeats, and never empty while anything is in scope.

Every stage is a table with all questions in it. Stages that later ones read twice are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.lexical import LexicalIndex, lexical_search
from tessera.sources.tables import saved

WORD = r"[\p{L}\p{N}]{2,}"
FALLBACK = 3


@dataclass
class Stages:
    """What each stage left: (qid, chunk_id, ...) with rank."""

    vector: DataFrame
    lexical: DataFrame
    fused: DataFrame
    final: DataFrame


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0))


def targeted_by_year(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, scope: DataFrame | None, top: int) -> DataFrame:
    """(qid, id, distance, score, rank): for a question (qid, scope, text, v) with a year, the nearest chunks of the first document in
    its scope whose name holds that year; score 1 / (1 + distance)."""
    asked = questions.select("qid", "scope", F.element_at(T.extract_years(F.col("text")), 1).alias("year"), F.col("v").alias("q")).where("year IS NOT NULL AND q IS NOT NULL")
    named = chunks.select("doc_id", F.explode(F.array_distinct(T.extract_years(F.col("name")))).alias("year")).distinct()
    seen = asked.where("scope IS NULL").join(named, "year")
    if scope is not None:
        seen = seen.unionByName(asked.join(scope, "scope").join(named, ["year", "doc_id"]).select(seen.columns))
    first = saved(seen.groupBy("qid").agg(F.min("doc_id").alias("doc_id")), "documents-by-year")
    only = chunks.join(first.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("chunk_id").alias("id"))
    by_doc = only.select(F.col("doc_id").cast("string").alias("scope"), "id")
    queries = asked.join(first, "qid").select("qid", "q", F.col("doc_id").cast("string").alias("scope"))
    found = R.knn_search(vectors.join(only.select("id"), "id", "left_semi"), queries, top, scope=by_doc)
    return found.withColumn("score", 1 / (1 + F.col("distance")))


def retrieve(questions: DataFrame, variants: list[Column], chunks: DataFrame, vectors: DataFrame, index: LexicalIndex, scope: DataFrame | None = None, scores: DataFrame | None = None, pool: int = 20, top: int = 8, threshold: float = 1.5) -> Stages:
    """questions (qid, scope, text, v), chunks (chunk_id, doc_id, idx, page, name, text), vectors (id, v) with a chunk's id; scope (scope, doc_id).

    Questions are expanded by `variants`, columns over text. A null scope allows all documents, one without documents none. Vectors of chunks that are
    gone, and chunks without text, are no candidates. Chunks with the article that a question refers to come first in the vector list, at half their distance.
    scores (qid, id, score) of a model order the final list where they are given. Questions that end with nothing get the nearest chunks of their scope."""
    asked = R.expand_queries(questions.select("qid", "text"), variants).join(questions.select("qid", "scope"), "qid")
    own = questions.select("qid", "scope", F.col("v").alias("q"))
    by_chunk = None if scope is None else scope.join(chunks.select("doc_id", F.col("chunk_id").alias("id")), "doc_id").select("scope", "id")
    body = chunks.select("chunk_id", "doc_id", "idx", "page", "name", "text")
    with_text = saved(vectors.join(body.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col("chunk_id").alias("id")), "id", "left_semi"), "vectors-with-text")

    texts_of = lambda found: found.join(R.only(body, found, "chunk_id"), "chunk_id")  # noqa: E731  of a stored list
    near = texts_of(saved(R.knn_search(with_text, own, pool, scope=by_chunk).withColumnRenamed("id", "chunk_id"), "nearest"))
    ref = questions.select("qid", T.extract_article_ref(T.normalize_query(F.col("text"))).alias("_ref"))
    near = near.join(R.query_side(ref), "qid")
    vector = R.boost_hits(near, F.coalesce(T.contains_article_ref(F.col("text"), F.col("_ref")) & F.col("_ref").isNotNull(), F.lit(False)))
    vector = saved(vector.select("qid", "chunk_id", "doc_id", "idx", "page", "text", "name", "distance", "rank"), "vector-list")
    lexical = texts_of(saved(lexical_search(index, body, asked.select("qid", "scope", "text"), pool, scope), "lexical-hits"))
    lexical = saved(lexical.select("qid", "chunk_id", "doc_id", "idx", "page", "text", "name", "score", "rank"), "lexical-list")

    key = R.candidate_key(F.col("doc_id"), F.col("idx"), F.col("chunk_id"), F.col("page"), F.col("text"))
    both = vector.select("qid", key.alias("key"), F.lit("vector").alias("method"), "rank", "distance", "chunk_id", "doc_id").unionByName(
        lexical.select("qid", key.alias("key"), F.lit("lexical").alias("method"), "rank", F.lit(None).cast("double").alias("distance"), "chunk_id", "doc_id")
    )
    facts = both.groupBy("qid", "key").agg(F.min("distance").alias("distance"), F.min("chunk_id").alias("chunk_id"), F.min("doc_id").alias("doc_id"))
    fused = R.rrf_fuse(both).join(facts, ["qid", "key"]).withColumnRenamed("methods", "method")
    fused = saved(fused.select("qid", "key", "chunk_id", "doc_id", "method", "rrf", "distance", "rank"), "fused-list")

    rows = R.threshold_with_floor(fused, threshold).join(R.only(body.select("chunk_id", "name", "text"), fused, "chunk_id"), "chunk_id").join(R.query_side(questions.select("qid", F.col("text").alias("asked"))), "qid")
    wanted, here = _words(F.col("asked")), _words(F.col("text"))
    share = lambda xs: F.size(F.array_intersect(wanted, xs)) / F.greatest(F.size(wanted), F.lit(1))
    said, body_ref = T.normalize_query(F.col("text")), T.extract_article_ref(T.normalize_query(F.col("asked")))
    rows = rows.select(
        "qid", F.col("chunk_id").alias("id"), "rank", "distance", "method",
        share(here).alias("body_overlap"), share(_words(F.col("name"))).alias("title_overlap"),
        (T.detect_language(F.col("asked")) != T.detect_language(F.col("text"))).alias("cross_language"),
        said.contains(T.normalize_query(F.col("asked"))).alias("phrase"),
        F.coalesce(body_ref.isNotNull() & T.contains_article_ref(said, body_ref), F.lit(False)).alias("article"),
        F.exists(T.extract_years(F.col("asked")), lambda y: F.coalesce("name", F.lit("")).contains(y)).alias("year"),
        here.alias("words"),
    )
    ranked = saved(R.heuristic_rerank(rows).drop("rank").withColumnRenamed("new_rank", "rank"), "reranked-list")
    chosen = R.suppress_text_duplicates(ranked.select("qid", "id", "rank", "words"), top if scores is None else max(top, pool))
    final = chosen.select("qid", "id", F.col("place").alias("rank")).join(ranked.select("qid", "id", "method", "score"), ["qid", "id"])
    if scores is not None:
        given = R.rescore_top_k(final.drop("score"), scores, top).drop("rank").withColumnRenamed("new_rank", "rank")
        final = given.select("qid", "id", "rank", "method", "score")
    final = saved(final.where(F.col("rank") <= top), "final-list")
    empty = saved(own.join(final.select("qid").distinct(), "qid", "left_anti"), "empty-questions")
    nearest = R.knn_search(with_text, empty, FALLBACK, scope=by_chunk)
    rest = nearest.select("qid", "id", "rank", F.lit("fallback").alias("method"), F.lit(None).cast("double").alias("score"))
    return Stages(vector, lexical, fused, final.unionByName(rest).withColumnRenamed("id", "chunk_id"))
