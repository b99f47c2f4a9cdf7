"""Corpus construction and chunking over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import corpus as J
from tessera.plans.registry import Registry, table
from tessera.sources.tables import saved

reg = Registry()


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks, three lines to a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return d.select("doc_id", F.expr("ord div 3").cast("int").alias("page"), "ord", "text")


_B = "b AS (SELECT doc_id, CAST((i - 1) // 3 AS INT) AS page, i - 1 AS ord, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@reg.add(f"""WITH {_B}, m AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord DESC) AS e FROM b),
p AS (SELECT doc_id, count(DISTINCT page) AS n FROM b GROUP BY 1 HAVING count(DISTINCT page) >= 3), o AS (SELECT doc_id, line FROM m JOIN p USING (doc_id) WHERE (t <= 2 OR e <= 2) AND length(line) < 100 AND line <> '' GROUP BY doc_id, line, n HAVING count(DISTINCT page) >= 0.6 * n)
SELECT doc_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM m WHERE (doc_id, line) NOT IN (SELECT doc_id, line FROM o) GROUP BY doc_id""")
def drop_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_headers_footers(_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@reg.add()
def split_and_classify_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.units(_blocks(spark, sf_dir)).select("doc_id", "page", "ord", "sub", "kind", F.length("text").alias("chars"))


@reg.add()
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_corpus(_blocks(spark, sf_dir))


@reg.add()
def split_fixed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", C.fixed_pieces(F.col("text")).alias("pieces"))
    return d.select("doc_id", F.posexplode("pieces").alias("piece", "text"))


@reg.add(r"SELECT count(*) AS chunks, round(avg(length(text)), 4) AS mean, quantile_cont(length(text), 0.5) AS median, max(length(text)) AS longest, round(avg(CAST(regexp_matches(text, '\b(19|20)\d{2}\b') AS INT)), 6) AS with_year FROM documents")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_stats(table(spark, sf_dir, "documents").select("text"))


@reg.add("""WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(array_to_string(l[1:5], ' ')), '[ӯқҳҷғӣ]') THEN 'tj' ELSE 'ru' END AS language FROM t""")
def doc_language_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of the first five chunks (here lines) of each document."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.array_join(F.slice(lines, 1, 5), " ")).alias("language"))


@reg.add("SELECT page_id, sha1(CASE WHEN page_id % 3 = 0 OR trim(url) = '' OR url IS NULL THEN html[:2000] ELSE trim(url) END)[:20] AS id FROM pages")
def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", J.document_id(url, F.col("html")).alias("id"))


@reg.add("SELECT count(*) FILTER (length(trim(text)) >= 200) AS kept, count(*) FILTER (length(trim(text)) < 200) AS skipped FROM documents")
def filter_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_ = F.length(F.trim("text")) >= 200
    return table(spark, sf_dir, "documents").agg(F.count_if(long_).alias("kept"), F.count_if(~long_).alias("skipped"))


@reg.add()
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a source id and a 400-character prefix, in doc_id order."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text")).alias("id"), F.md5(J.prefix_key(F.col("text"))).alias("prefix"))
    return J.dedup_first_wins(d, "doc_id", ["id", "prefix"], saved)


_RUBRIC = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'news' WHEN source IN ('src3', 'src4') THEN 'law' WHEN source IN ('src5', 'src6') THEN 'unlabelled' END"


@reg.add(f"SELECT doc_id, {_RUBRIC} AS rubric FROM documents")
def map_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("src0", "news"), ("src1", "news"), ("src2", "news"), ("src3", "law"), ("src4", "law")], "s string, r string")
    ignored = spark.createDataFrame([("src5",), ("src6",)], "s string")
    return J.map_rubric(table(spark, sf_dir, "documents").select("doc_id", "source"), T.canonical_section(F.col("source")), names, ignored).select("doc_id", "rubric")


@reg.add("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source) < 40 THEN 'unlabelled' ELSE source END AS rubric FROM documents")
def demote_small_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.demote_small(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rubric")), "rubric", 40)


@reg.add("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN p <= round(n * 0.7) THEN 'train' WHEN p <= round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "split")


@reg.add("WITH r AS (SELECT turn, CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM conversations) SELECT turn, count(DISTINCT split) AS splits FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1")
def load_splits_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that leak between splits."""
    split = F.when(F.col("conv_id") % 3 == 0, "train").when(F.col("conv_id") % 3 == 1, "validation").otherwise("test")
    return J.split_leaks(table(spark, sf_dir, "conversations").select("turn", split.alias("split")), "turn")


@reg.add("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.counts_by(table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@reg.add(r"""SELECT lang, count(*) AS records, count(*) - count(DISTINCT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS exact_duplicates, min(w) AS shortest, quantile_cont(w, 0.5) AS median, round(quantile_cont(w, 0.95), 4) AS p95, max(w) AS longest
FROM (SELECT lang, text, len(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY lang""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.quality_report(table(spark, sf_dir, "documents").select("lang", "text"), "text", ["lang"])


@reg.add("SELECT source, count(*) AS n, count(DISTINCT lang) AS languages, round(avg(CASE WHEN l.quality IS NULL THEN 0.0 ELSE 1.0 END), 6) AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id GROUP BY source")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("languages"), F.round(F.avg(F.col("quality").isNotNull().cast("double")), 6).alias("labelled"))


@reg.add(r"""WITH d AS (SELECT doc_id, source, lang, length(trim(text)) < 200 AS short, md5(left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 400)) AS p FROM documents),
f AS (SELECT p, min(doc_id) AS first FROM d WHERE NOT short GROUP BY p), s AS (SELECT d.*, CASE WHEN short THEN 'short' WHEN doc_id <> first THEN 'duplicate' ELSE 'kept' END AS state FROM d LEFT JOIN f USING (p))
SELECT 'outcome' AS field, state AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s WHERE state = 'kept' GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM s WHERE state = 'kept' GROUP BY 2
UNION ALL SELECT 'unknown section', source, count(*) FROM s WHERE state = 'kept' AND source NOT IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY 2""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build over documents; sections with a document that is labelled toxic stand for the known ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    known = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source")
    return J.build_report(d, "doc_id", "text", ["source", "lang"], known, "source")


@reg.add("""WITH n AS (SELECT source AS topic, lang AS language, min(source || lang) AS nm, count(DISTINCT n_chars % 2) AS k FROM documents GROUP BY ALL) SELECT topic, language, k AS names FROM n WHERE k > 1""")
def localized_topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of topic and language with more than one name."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("lang").alias("language"), (F.col("n_chars") % 2).cast("string").alias("name"))
    return J.localized_names(d, d)[1]


_TERMS = r"t AS (SELECT source AS grp, doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}{3,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))) AS term FROM documents)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their documents, dealt by document before the texts are split, so that counts by document need no further shuffle."""
    return table(spark, sf_dir, "documents").select("source", "doc_id", "text").repartition("doc_id").select(F.col("source").alias("grp"), F.col("doc_id").alias("doc"), F.explode(T.label_tokens(F.col("text"))).alias("term"))


@reg.add(f"""WITH {_TERMS}, n AS (SELECT grp, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL), s AS (SELECT grp, sum(n) AS size FROM n GROUP BY grp), d AS (SELECT grp, count(DISTINCT doc) AS o FROM t GROUP BY grp), e AS (SELECT term, sum(n) AS total, count(*) AS groups FROM n GROUP BY term),
m AS (SELECT avg(size) AS mean, count(*) AS g FROM s), w AS (SELECT grp, term, n, round(n / size * ln(1 + mean / total), 9) AS weight FROM n JOIN s USING (grp) JOIN d USING (grp) JOIN e USING (term), m WHERE n >= 2 AND groups <= 0.7 * g AND docs >= CASE WHEN o >= 5 THEN greatest(2, 0.15 * o) ELSE 0 END)
SELECT grp, term, n, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 8""")
def c_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.c_tf_idf(_terms(spark, sf_dir), 8).select("grp", "term", "n", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


@reg.add(f"WITH {_TERMS}, n AS (SELECT grp, term, count(*) AS n FROM t GROUP BY ALL) SELECT grp, term, n FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS s FROM n) WHERE n >= 0.6 * s AND n > 3")
def only_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _terms(spark, sf_dir).groupBy("grp", "term").agg(F.count("*").alias("n")).withColumn("family", F.lit("all"))
    return J.only_dominant(n).where("n > 3").select("grp", "term", "n")


@reg.add("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def write_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by language and read back: counts."""
    d = saved(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "corpus", ["lang"])
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"))


@reg.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_store_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@reg.add("SELECT coalesce(p.page_id, l.doc_id) AS id, CASE WHEN p.page_id IS NULL THEN 'no file' WHEN l.doc_id IS NULL THEN 'no manifest' ELSE 'both' END AS state FROM pages p FULL JOIN labels l ON l.doc_id = p.page_id")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = table(spark, sf_dir, "pages").select("page_id"), table(spark, sf_dir, "labels").select("doc_id")
    state = F.when(F.col("page_id").isNull(), "no file").when(F.col("doc_id").isNull(), "no manifest").otherwise("both")
    return p.join(m, p.page_id == m.doc_id, "full").select(F.coalesce("page_id", "doc_id").alias("id"), state.alias("state"))


@reg.add("""WITH p AS (SELECT conv_id, turn, text AS q, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role FROM conversations)
SELECT conv_id, turn, md5('### Instruction:' || chr(10) || q || chr(10) || '### Response:' || chr(10) || a) AS digest, CASE WHEN md5(conv_id || ':' || turn) < '1999' THEN 'test' ELSE 'train' END AS split FROM p WHERE role = 'user' AND a IS NOT NULL""")
def instruction_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with their answers as prompts, nine in ten to train by md5."""
    from pyspark.sql import Window

    answer = F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", answer.alias("a")).where("role = 'user' AND a IS NOT NULL")
    prompt = F.concat(F.lit("### Instruction:\n"), "text", F.lit("\n### Response:\n"), "a")
    h = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return p.select("conv_id", "turn", F.md5(prompt).alias("digest"), F.when(h < "1999", "test").otherwise("train").alias("split"))
