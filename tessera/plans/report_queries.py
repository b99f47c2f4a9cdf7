"""Reports over the driver's tables: events stand for the call log and jobs, orders for owned rows, conversations for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import Registry, table

reg = Registry()


@reg.add("""SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS refusals, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS refusal_ratio,
round(avg(coalesce(value, 0)), 4) AS mean_time_ms, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'view') AS down FROM events""")
def log_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rating = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "view", "down")
    return R.log_kpis(e.select((F.col("event_type") == "purchase").alias("refused"), F.col("value").alias("time_ms"), rating.alias("rating")))


@reg.add("""SELECT trim(text) AS question, count(*) AS n, min(conv_id * 1000 + turn) AS first_id FROM conversations WHERE role = 'user' AND trim(text) <> ''
GROUP BY 1 ORDER BY n DESC, first_id LIMIT 5""")
def top_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return R.top_questions(c.select(F.col("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id")))


@reg.add("""SELECT o_orderkey, o_custkey, o_orderdate, t.total FROM orders, (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F') t WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50""")
def page_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.page_of(o, "o_orderdate", "o_orderkey", 50, 25)


@reg.add("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return R.owned_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mine, "o_custkey")


@reg.add("""SELECT CAST(i AS INT) AS label, count(e.vec_id) AS n, round(count(e.vec_id) / sum(count(e.vec_id)) OVER (), 6) AS share
FROM range(40) r(i) LEFT JOIN embeddings e ON e.label = i GROUP BY i""")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distribution(table(spark, sf_dir, "embeddings").select("label"), "label", 40)


@reg.add("""SELECT count(*) FILTER (v IS NOT NULL AND quality IS NULL) AS unclear, count(*) FILTER (v < 2) AS stale, count(*) FILTER (v IS NULL) AS untouched, count(*) AS total
FROM (SELECT d.doc_id, l.quality, CASE WHEN d.n_chars > 500 THEN 1 + d.doc_id % 2 END AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.coverage(d, F.when(F.col("n_chars") > 500, 1 + F.col("doc_id") % 2), F.lit(2), F.col("quality"))


@reg.add("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM n)
SELECT source, max(lang) FILTER (r = 1) AS top_folder, max(n) AS top_n, count(*) AS folders, CAST(sum(n) AS BIGINT) AS n, string_agg(lang, ',' ORDER BY r) FILTER (r <= 3) AS top3 FROM r GROUP BY source""")
def subject_vs_topic_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.subject_purity(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


@reg.add("""SELECT DISTINCT page_id AS doc_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_ids(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), table(spark, sf_dir, "labels"), "doc_id")


_VECTORS = "SELECT CASE WHEN vec_id % 50 = 0 THEN 'x' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS id FROM embeddings"


@reg.add(f"""SELECT id, TRY_CAST(id AS BIGINT) IS NULL AS not_numeric FROM ({_VECTORS}) WHERE TRY_CAST(id AS BIGINT) IS NULL OR TRY_CAST(id AS BIGINT) NOT IN (SELECT doc_id FROM labels)""")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 50 == 0, F.concat(F.lit("x"), F.col("vec_id").cast("string"))).otherwise(F.col("vec_id").cast("string")).alias("id"))
    return R.orphan_vectors(v, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@reg.add("""WITH v AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'kb_new' WHEN 1 THEN 'kb_old' ELSE 'other' END AS collection FROM embeddings
UNION ALL SELECT vec_id + 1, 'kb_new' FROM embeddings) SELECT id, collection FROM v WHERE collection = 'kb_old' AND id IN (SELECT id FROM v WHERE collection = 'kb_new')""")
def stale_collection_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    kind = F.when(F.col("label") % 3 == 0, "kb_new").when(F.col("label") % 3 == 1, "kb_old").otherwise("other")
    v = e.select(F.col("vec_id").alias("id"), kind.alias("collection")).unionByName(e.select((F.col("vec_id") + 1).alias("id"), F.lit("kb_new").alias("collection")))
    return R.stale_vectors(v, "kb_", "kb_new")


@reg.add("""WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7), busy AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT t AS "table", id, k IN (SELECT k FROM busy) AS blocked FROM (SELECT 'orders' AS t, o_orderkey AS id, o_custkey AS k FROM orders UNION ALL
SELECT 'lineitem', l_orderkey * 10 + l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE k IN (SELECT k FROM gone)""")
def cascade_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("notebook_id"))
    orders = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notebook_id"))
    items = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("o_custkey").alias("notebook_id"))
    return R.cascade_plan(gone, {"orders": orders, "lineitem": items}, o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("notebook_id")))


@reg.add("""SELECT o_orderkey, o_custkey, CAST(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100000 END,
(SELECT min_by(c_custkey, (c_acctbal, c_custkey)) FROM customer WHERE c_mktsegment = 'BUILDING')) AS BIGINT) AS owner_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def backfill_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).cast("long").alias("owner_id"))
    owners = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 100000).cast("long").alias("owner_id"))
    admins = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_acctbal").alias("created_at"))
    return R.backfill_owner(rows, owners, admins, "o_custkey")


@reg.add("""SELECT conv_id, turn, CAST(coalesce(CASE WHEN turn % 2 = 0 THEN turn END, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS BIGINT) AS idx FROM conversations""")
def backfill_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("idx"))
    return R.backfill_index(c, "conv_id", "turn", "idx")


@reg.add("""SELECT doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic, coalesce(lang, 'en') AS lang FROM (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 20)""")
def backfill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 20").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.fillna({"quality": 1, "toxic": 0, "lang": "en"}).select("doc_id", "quality", "toxic", "lang")


@reg.add("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1""")
def conflicting_active_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicting(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "O")


@reg.add("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view'""")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return R.queue_position(e, F.col("event_type") == "view", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", F.col("position").cast("long").alias("position"))


@reg.add("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN user_id % 5 >= CASE WHEN event_type = 'view' THEN 4 ELSE 3 END THEN 'failed' ELSE 'queued' END AS new_status
FROM events, m WHERE event_type <> 'click' AND (event_id % 7 = 0 OR ts < now - INTERVAL 60 SECOND)""")
def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    jobs = e.select("event_id", F.col("event_type").alias("job_type"), F.when(F.col("event_type") == "click", "done").otherwise("running").alias("status"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("lease_at"), (F.col("user_id") % 5).alias("attempts"))
    return R.expired_leases(jobs.join(F.broadcast(now)), F.col("now"), limits={"view": 4}).select("event_id", "new_status")


_STATUS = "CASE doc_id % 3 WHEN 0 THEN 'indexing' WHEN 1 THEN 'pending' ELSE 'indexed' END"
_JOB = "CASE page_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END"


@reg.add(f"""WITH d AS (SELECT doc_id, {_STATUS} AS status, CASE WHEN doc_id % 5 = 0 THEN 'kept' END AS error_text FROM documents), j AS (SELECT page_id AS doc_id, {_JOB} AS status FROM pages),
s AS (SELECT *, CASE WHEN status = 'indexing' AND doc_id IN (SELECT doc_id FROM j WHERE status = 'queued') THEN 'pending'
WHEN doc_id NOT IN (SELECT doc_id FROM j WHERE status IN ('queued', 'running')) THEN 'error' END AS new_status FROM d WHERE status IN ('indexing', 'pending'))
SELECT doc_id, new_status, CASE WHEN new_status = 'error' THEN coalesce(error_text, 'interrupted') ELSE error_text END AS error_text FROM s WHERE new_status IS NOT NULL""")
def stuck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_STATUS).alias("status"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'kept' END").alias("error_text"))
    j = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.expr(_JOB).alias("status"))
    return R.stuck_documents(d, j).select("doc_id", "new_status", "error_text")


@reg.add("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, max(value) AS longest, round(sum(value), 2) AS total, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def call_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.timing_summary(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


@reg.add("""SELECT conv_id, turn AS question_turn, text AS question, answer, user_turn FROM (SELECT conv_id, turn, role, text, lead(CASE WHEN role = 'assistant' THEN text END) OVER w AS answer,
row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS user_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND user_turn <= 5""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five exchanges of each conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    answer = F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    back = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    out = c.withColumn("answer", answer).withColumn("user_turn", back.cast("long")).where("role = 'user' AND user_turn <= 5")
    return out.select("conv_id", F.col("turn").alias("question_turn"), F.col("text").alias("question"), "answer", "user_turn")
