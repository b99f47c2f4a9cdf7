"""Text expressions over whole tables. Long results are returned as md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lexical import tokenized
from tessera.plans.registry import Registry, table

reg = Registry()


@reg.add(r"SELECT item_id, regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g') AS query FROM benchmark")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("query"))


_LOWER = "lower(text)"


@reg.add(f"""SELECT conv_id, turn, CASE WHEN regexp_matches({_LOWER}, '[{T.TAJIK_LETTERS}]') THEN 'tj' ELSE 'ru' END AS language,
{" OR ".join(f"contains({_LOWER}, '{p}')" for p in T.INJECTION_PHRASES)} AS injection, {" OR ".join(f"contains(regexp_replace({_LOWER}, '[ \\n\\t]+', ' ', 'g'), '{p}')" for p in T.NO_DATA_PHRASES)} AS no_data,
regexp_matches({_LOWER}, '\\b({T.GREETINGS})\\b') AND len(regexp_extract_all(text, '\\S+')) <= 3 AS greeting, {" OR ".join(f"contains({_LOWER}, '{p}')" for p in T.REASONING_MARKERS)} AS reasons FROM conversations""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, injection, refusal, greeting and reasoning marks of each turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.detect_language(t).alias("language"), T.flag_prompt_injection(t).alias("injection"), T.flag_no_data_answer(t).alias("no_data"), T.flag_greeting(t).alias("greeting"), T.has_reasoning_markers(t).alias("reasons"))


@reg.add()
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning and numeric questions, article references and their twin form."""
    t = F.col("text")
    ref = T.extract_article_ref(t)
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.flag_reasoning_question(t).alias("reasoning"), T.flag_numeric_question(t).alias("numeric"), ref.alias("ref"), T.article_ref_variants(ref).alias("variants"))


@reg.add(r"SELECT page_id, array_to_string(regexp_extract_all(html || ' 1999 and 2024, ' || page_id, '\b((?:19|20)\d{2})\b', 1), ',') AS years FROM pages")
def extract_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("html", F.lit(" 1999 and 2024, "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.extract_years(t), ",").alias("years"))


@reg.add(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\\[a-zA-Z]+', ' ', 'g'), '{}', ''), ' {3,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def clean_corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_corpus_text(F.col("text"))).alias("digest"))


@reg.add(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '(?m)^[ \t]*\d{1,4}[ \t]*$\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def normalize_extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_extracted_text(F.col("text"))).alias("digest"))


@reg.add(r"""SELECT doc_id, length(trim(text)) < 80 OR length(regexp_replace(trim(text), '[^\p{L}\p{N}]', '', 'g')) / greatest(length(trim(text)), 1) < 0.3 AS needs_ocr FROM documents""")
def page_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.page_needs_ocr(F.col("text")).alias("needs_ocr"))


@reg.add()
def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.redact_paths(F.col("url")).alias("url"))


@reg.add(r"SELECT source, lang, lower(trim(regexp_replace('  ' || source || '   ' || lang, '\s+', ' ', 'g'))) AS section, count(*) AS n FROM documents GROUP BY ALL")
def canonical_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", T.canonical_section(F.concat(F.lit("  "), "source", F.lit("   "), "lang")).alias("section"))
    return d.groupBy("source", "lang", "section").agg(F.count("*").alias("n"))


@reg.add("SELECT doc_id, md5('[' || source || ' | ' || lang || ' | page ' || doc_id % 5 || ']' || chr(10) || text) AS made, TRUE AS restored FROM documents")
def build_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    made = T.build_embedding_text(F.col("source"), F.array("source", "lang"), F.col("doc_id") % 5, F.col("text"))
    return d.select("doc_id", F.md5(made).alias("made"), (T.strip_service_prefix(made) == F.col("text")).alias("restored"))


@reg.add(r"""WITH t AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}{3,}'), lambda x: x NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + r"""))) AS term FROM documents) SELECT source, term, count(*) AS n FROM t GROUP BY ALL""")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.explode(T.label_tokens(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))


@reg.add("SELECT doc_id, greatest(1, CAST(floor(length(text) / 3.6) AS BIGINT)) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@reg.add(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT word, CASE WHEN length(word) <= 3 THEN word
ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2]))), ' ') END AS grams FROM w""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return words.select("word", F.array_join(T.char_ngrams(F.col("word")), " ").alias("grams"))


TOKENS_SQL = rf"""raw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) AS word FROM documents) GROUP BY ALL),
both_ AS (SELECT doc_id, word, n, FALSE AS part FROM raw UNION ALL SELECT doc_id, unnest(string_split(word, '-')), n, TRUE FROM raw WHERE contains(word, '-')),
known AS (SELECT * FROM both_ WHERE word NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) AND (length(word) >= 2 OR regexp_matches(word, '^[0-9]+$'))),
terms AS (SELECT doc_id, term, sum(n)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(CASE WHEN NOT part AND length(word) >= 4 THEN
list_concat([word], list_distinct(list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2]))) ELSE [word] END) AS term FROM known) GROUP BY ALL)"""


@reg.add(f"WITH {TOKENS_SQL} SELECT * FROM terms")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@reg.add()
def extractive_fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two sentences of each conversation's assistant turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.first_sentences(F.array("text")).alias("answer"))


@reg.add()
def sanitize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(T.sanitize_answer(F.col("text"))).alias("digest"))
