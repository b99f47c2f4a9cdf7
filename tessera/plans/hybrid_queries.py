"""Scoped lexical search and hybrid retrieval over the driver's tables: documents are the chunks, benchmark passages the questions; the vector of a document or
question is the embedding of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import hybrid as H
from tessera.operators import lexical as L
from tessera.operators import retrieval as R
from tessera.plans.registry import Registry, table
from tessera.plans.text_queries import TOKENS_SQL
from tessera.sources.tables import saved

reg = Registry()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("idx"), F.lit(1).alias("page"), F.col("source").alias("name"), "lang", "text")


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope "good": documents labelled so; scope "en": English documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.lit("good").alias("scope"), "doc_id")
    return good.unionByName(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit("en").alias("scope"), "doc_id"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third question searches all documents, the others one of two scopes."""
    kind = F.col("item_id") % 3
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(kind == 1, "good").when(kind == 2, "en").alias("scope"), "text")


def _variants(questions: DataFrame) -> DataFrame:
    made = R.expand_queries(questions, [F.lower("text"), F.regexp_replace("text", "[.,]", "")])
    return made.join(questions.select("qid", "scope"), "qid").select("qid", "scope", "text")


SCOPED_SQL = rf"""{TOKENS_SQL},
q AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 1 THEN 'good' WHEN 2 THEN 'en' ELSE '' END AS scope, text FROM benchmark),
qraw AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) AS word FROM (SELECT qid, text FROM q UNION ALL SELECT qid, regexp_replace(text, '[.,]', '', 'g') FROM q)),
qboth AS (SELECT qid, word, FALSE AS part FROM qraw UNION ALL SELECT qid, unnest(string_split(word, '-')), TRUE FROM qraw WHERE contains(word, '-')),
qknown AS (SELECT * FROM qboth WHERE word NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) AND (length(word) >= 2 OR regexp_matches(word, '^[0-9]+$'))),
qt AS (SELECT DISTINCT qid, unnest(CASE WHEN NOT part AND length(word) >= 4 THEN list_concat([word], list_distinct(list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2]))) ELSE [word] END) AS term FROM qknown),
w AS (SELECT qid, term, CASE WHEN length(term) = 3 AND EXISTS (SELECT 1 FROM qt l WHERE l.qid = qt.qid AND length(l.term) > 3 AND contains(l.term, qt.term)) THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM qt),
sc AS (SELECT '' AS scope, doc_id FROM documents UNION ALL SELECT DISTINCT 'good', doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'en', doc_id FROM documents WHERE lang = 'en'),
dl AS (SELECT doc_id, sum(tf) AS dl FROM terms GROUP BY doc_id),
st AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM sc JOIN dl USING (doc_id) GROUP BY scope),
hit AS (SELECT scope, doc_id, term, tf FROM terms JOIN sc USING (doc_id) WHERE term IN (SELECT term FROM w)),
df AS (SELECT scope, term, count(*) AS df FROM hit GROUP BY ALL),
base AS (SELECT q.qid, hit.doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS base
  FROM q JOIN w USING (qid) JOIN hit ON hit.scope = q.scope AND hit.term = w.term JOIN df ON df.scope = hit.scope AND df.term = hit.term JOIN st ON st.scope = q.scope JOIN dl ON dl.doc_id = hit.doc_id GROUP BY ALL),
norm AS (SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS t FROM documents),
score AS (SELECT qid, base.doc_id, round(base + CASE WHEN contains(t, regexp_replace(lower(trim(q.text)), '\s+', ' ', 'g')) OR contains(t, regexp_replace(lower(trim(regexp_replace(q.text, '[.,]', '', 'g'))), '\s+', ' ', 'g')) THEN 0.25 ELSE 0 END, 6) AS score
  FROM base JOIN q USING (qid) JOIN norm USING (doc_id)),
scoped AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS b FROM score) WHERE score >= 0.15 * b)"""


@reg.add(f"WITH {SCOPED_SQL} SELECT qid, doc_id, round(score, 4) AS score, rank FROM scoped WHERE rank <= 10")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their variants, each within its scope, by stems and their 3-grams, with bonuses."""
    chunks = _chunks(spark, sf_dir)
    found = L.lexical_search(L.LexicalIndex.build(chunks), chunks, _variants(_questions(spark, sf_dir)), 10, _scopes(spark, sf_dir))
    return found.select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hybrid(spark: SparkSession, sf_dir: str) -> H.Stages:
    chunks = _chunks(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    questions = _questions(spark, sf_dir).join(e.select(F.col("id").alias("qid"), "v"), "qid", "left")
    return H.retrieve(questions, [F.lower("text"), F.regexp_replace("text", "[.,]", "")], chunks, e.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi"), L.LexicalIndex.build(chunks), _scopes(spark, sf_dir))


@reg.add()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final list of every question."""
    return _hybrid(spark, sf_dir).final.select("qid", F.col("chunk_id").alias("id"), "rank", "method", F.round("score", 4).alias("score"))


@reg.add(f"""WITH {SCOPED_SQL}, v AS (SELECT q.qid, d.doc_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS distance
FROM q JOIN embeddings a ON a.vec_id = q.qid JOIN sc d ON d.scope = q.scope JOIN embeddings b ON b.vec_id = d.doc_id JOIN documents t ON t.doc_id = d.doc_id WHERE trim(t.text) <> ''),
near AS (SELECT qid, doc_id, round(distance, 9) AS distance, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), doc_id) AS rank FROM v),
u AS (SELECT qid, doc_id, 'vector' AS method, rank FROM near WHERE rank <= 20 UNION ALL SELECT qid, doc_id, 'lexical', rank FROM scoped WHERE rank <= 20),
f AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS rrf, string_agg(DISTINCT method, '+' ORDER BY method) AS method, min(rank) FILTER (method = 'vector') AS vr, min(rank) FILTER (method = 'lexical') AS lr FROM u GROUP BY ALL)
SELECT qid, doc_id, method, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, vr NULLS LAST, lr NULLS LAST, 'd:' || doc_id || ':0') AS rank FROM f""")
def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused lists of hybrid_retrieve, before distances cut them."""
    return _hybrid(spark, sf_dir).fused.select("qid", "doc_id", "method", F.col("rank").cast("long").alias("rank"))
