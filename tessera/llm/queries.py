"""The registered queries of this subpackage, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, jaccard_join, line_dedup, nbsvm, packing, periodic_runs, phrases, quality_rules, sharding, token_counts, token_ids, url_filter
from tessera.llm.shared import broadcast_if_small, written

LABEL_ROWS = 2_000_000  # largest table of labels that is broadcast


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = docs.where(~held_out).join(broadcast_if_small(labels, LABEL_ROWS), "doc_id").select("text", "label")
    out = nbsvm.score(docs, nbsvm.train(known))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), words=token_ids.FILE_WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.index(spark, token_ids.encode_to_files(_table(spark, sf_dir, "documents")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(written(chat_format.format_conversations(turns), "chat"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(_table(spark, sf_dir, "documents"), jaccard_join.Likeness(3, 9, 10))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select("url", bad)
    return url_filter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.read_shards(spark, sharding.shard_files(docs), docs.schema)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", sharding.size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which the words of a tenth of the texts, from one place on, repeat the first of them, so that runs are known."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("_w")
    a = (g % n).cast("int")
    chosen = chosen.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")))
    word = lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return chosen.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(_with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), digest(periodic_runs.listed(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")
    )


_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(quality_rules.STOP_WORDS))

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM x JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * x >= 90 * (p.n + q.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(r, o) AS (SELECT r, r FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.o)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN t ON t.r = d.r JOIN d o ON o.r = t.o GROUP BY d.r, d.doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING m = 1 OR f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, g, string_split(g, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.g, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = k.x JOIN f y ON y.lang = k.lang AND y.g = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE m = 3) GROUP BY ALL),
z AS (SELECT b.*, b.g AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.g WHERE held IS NULL OR 100 * held < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_packing,
        op4_line_dedup,
        op5_decontaminate,
        op6_token_ids,
        op7_chat_format,
        op8_token_counts,
        op9_ngram_jaccard,
        op10_url_filter,
        op11_collocations,
        op12_sharding,
        op13_periodic_runs,
    )
}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_collocations": OP11_SQL}
