"""Choosing and describing topic models over embeddings and documents."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import corpus as J
from tessera.operators import search as X
from tessera.operators import stores as O
from tessera.operators import topics as P
from tessera.operators import vectors as V
from tessera.plans.corpus_queries import _terms
from tessera.plans.registry import Registry, table
from tessera.plans.vector_queries import _A, _N, K, _seeds, _unit, stored
from tessera.sources.tables import saved, shared_folder

reg = Registry()


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.assign_nearest(rows, _seeds(rows))


_GRID = "SELECT CAST(n_chars // 1000 AS INT) AS k, count(DISTINCT source) / 20.0 AS ari, count(*) % 17 / 17.0 AS silhouette FROM documents GROUP BY 1"


@reg.add(f"WITH g AS ({_GRID}) SELECT k, round(ari, 6) AS ari, round(silhouette, 6) AS silhouette FROM g WHERE ari >= 0.8 * (SELECT max(ari) FROM g) ORDER BY g.silhouette DESC, k LIMIT 1")
def k_by_quality_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by thousands of characters stand for a grid of k."""
    d = table(spark, sf_dir, "documents").groupBy(F.expr("CAST(n_chars div 1000 AS INT)").alias("k"))
    grid = d.agg((F.count_distinct("source") / 20).alias("ari"), (F.count("*") % 17 / 17).alias("silhouette"))
    return P.k_by_quality_floor(grid).select("k", F.round("ari", 6).alias("ari"), F.round("silhouette", 6).alias("silhouette"))


@reg.add()
def merge_close_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model whose close centroids are merged: rows by cluster."""
    rows = stored(spark, sf_dir)
    centroids = V.kmeans_best(rows, [K], seed=1)[K][0]
    found = V.assign_nearest(rows, centroids)
    sizes = np.zeros(K)
    for r in found.groupBy("cluster").count().collect():  # K rows
        sizes[r["cluster"]] = r["count"]
    _, relabel = P.merge_close_centroids(centroids, sizes, 0.5)
    mapping = spark.createDataFrame([(i, int(x)) for i, x in enumerate(relabel)], "cluster int, merged int")
    return found.join(F.broadcast(mapping), "cluster").groupBy("merged").agg(F.count("*").alias("n"))


@reg.add()
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of merging a fitted model of twice as many clusters over a grid of cosines."""
    rows = stored(spark, sf_dir)
    centroids = V.kmeans_best(rows, [2 * K], seed=1)[2 * K][0]
    found = V.assign_nearest(rows, centroids).select("cluster", "label")
    return P.search_merge(found, centroids, "label", [0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


@reg.add()
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stability(stored(spark, sf_dir), 4)


@reg.add()
def strata_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).withColumn("stratum", F.col("id") % 2)
    return P.fit_per_stratum(rows, "stratum", 4).select("id", "stratum", "cluster")


_OUT = f"{_A}, t AS (SELECT quantile_cont(margin, 0.1) - 1e-9 AS t FROM a), o AS (SELECT d.doc_id AS id, e.label AS topic, a.cluster AS c, margin, CASE WHEN a.id IS NULL THEN 'skipped' WHEN margin >= t THEN 'assigned' ELSE 'unclear' END AS outcome FROM documents d LEFT JOIN a ON a.id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id, t)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its label standing for the topic of before."""
    found = _assigned(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(found.select("id", F.col("label").alias("topic")), "id", "left")
    return P.outcomes(docs, found, V.margin_threshold(found))


@reg.add(f"WITH {_OUT} SELECT count(*) AS documents, count(*) FILTER (outcome = 'assigned') AS assigned, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'unclear') AS unclear, count(*) FILTER (outcome = 'assigned' AND topic <> c) AS stale FROM o")
def reassign_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reassign_counts(_outcomes(spark, sf_dir))


@reg.add(f"WITH {_OUT} SELECT topic AS before, CASE WHEN outcome = 'assigned' THEN c END AS after, count(*) AS n, round(avg(margin), 3) AS margin FROM o WHERE outcome <> 'skipped' GROUP BY 1, 2")
def topic_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.before_after(_outcomes(spark, sf_dir)).withColumn("margin", F.round("margin", 3))


@reg.add(f"""WITH {_A}, h AS (SELECT a.id, cluster AS label, cost, v FROM a JOIN u USING (id) WHERE a.id % 5 = 0), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS p FROM h) JOIN (SELECT label, greatest(2, round(2000 * count(*) / sum(count(*)) OVER ())) AS take FROM h GROUP BY label) USING (label) WHERE p <= take),
z AS (SELECT label, count(*) AS size FROM s GROUP BY label), p AS (SELECT x.id, x.label, y.label AS other, sum(sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda q: (q[1] - q[2]) ** 2)))) AS t FROM s x, s y GROUP BY ALL),
m AS (SELECT p.id, max(CASE WHEN other = p.label AND size > 1 THEN t / (size - 1) END) AS a, min(CASE WHEN other <> p.label THEN t / size END) AS b FROM p JOIN z ON z.label = other GROUP BY p.id)
SELECT (SELECT count(*) FROM h) AS n, (SELECT count(DISTINCT label) FROM h) AS clusters, (SELECT round(sum(cost), 3) FROM h) AS inertia, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM m""")
def evaluate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal scores of the held-out fifth under a model of all rows."""
    held = _assigned(spark, sf_dir).where("id % 5 = 0")
    return V.internal_scores(held).select("n", "clusters", F.round("inertia", 3).alias("inertia"), F.round("silhouette", 4).alias("silhouette"))


_EXT = "x AS (SELECT k AS label, v, cluster, count(*) AS n FROM (SELECT 'label' AS k, CAST(label AS VARCHAR) AS v, cluster FROM a UNION ALL SELECT 'parity', CAST(id % 2 AS VARCHAR), cluster FROM a) GROUP BY ALL), c AS (SELECT label, cluster, sum(n) AS c, max(n) AS m FROM x GROUP BY ALL)"


@reg.add(f"WITH {_A}, {_EXT.replace('c AS (SELECT label, cluster', 'cc AS (SELECT label, cluster')} SELECT label, round(sum(m) / sum(c), 6) AS purity, CAST(sum(c) AS BIGINT) AS n FROM cc GROUP BY label")
def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir).withColumn("parity", F.col("id") % 2)
    return P.external_scores(rows, "cluster", ["label", "parity"]).select("label", "purity", "n")


@reg.add(f"WITH {_N} SELECT 'label' AS label, 1.0 AS purity, 1.0 AS ari, count(*) AS n FROM u")
def oracle_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the perfect labelling."""
    rows = _unit(spark, sf_dir).withColumn("cluster", F.col("label"))
    return P.external_scores(rows, "cluster", ["label"]).select("label", "purity", "ari", "n")


@reg.add("""WITH n AS (SELECT source AS cluster, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source AS cluster, n_chars % 4 AS topic, count(*) AS n FROM documents GROUP BY ALL),
l AS (SELECT cluster, min_by(lang, (-n, lang)) AS lang, round(max(n) / sum(n), 6) AS lang_share FROM n GROUP BY cluster), t AS (SELECT cluster, min_by(topic, (-n, topic)) AS topic, round(max(n) / sum(n), 6) AS topic_share, CAST(sum(n) AS BIGINT) AS size, count(*) AS topic_count FROM s GROUP BY cluster)
SELECT * FROM t JOIN l USING (cluster)""")
def cluster_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), (F.col("n_chars") % 4).alias("topic"), "lang")
    return P.cluster_breakdown(d, "cluster", "topic", "lang")


@reg.add()
def compose_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic names from c-TF-IDF words, sources standing for clusters."""
    ids = F.regexp_extract("grp", r"(\d+)", 1).cast("int")
    words = J.c_tf_idf(_terms(spark, sf_dir), 8).select(ids.alias("cluster"), "term", "rank")
    size = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), "lang").groupBy("grp").agg(F.mode("lang", True).alias("rubric"), F.max("lang").alias("x"))
    return P.compose_labels(words, size.select(ids.alias("cluster"), "rubric", F.lit(0.5).alias("share")))


@reg.add(r"""WITH q AS (SELECT conv_id * 100 + turn AS qid, CAST(1990 + turn AS VARCHAR) AS year FROM conversations WHERE role = 'user'), d AS (SELECT CAST(1990 + doc_id % 7 AS VARCHAR) AS year, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT qid, year, doc_id FROM q JOIN d USING (year)""")
def year_targeted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), (F.lit(1990) + F.col("turn")).cast("string").alias("y"))
    return P.year_targeted(q, table(spark, sf_dir, "documents").select("doc_id"), F.col("y"), (F.lit(1990) + F.col("doc_id") % 7).cast("string"))


@reg.add(r"""WITH k AS (SELECT count(DISTINCT label) AS k FROM embeddings) SELECT i AS version, CASE WHEN i = 1 THEN k ELSE k - 1 END AS clusters, i = 2 AS is_active FROM k, (VALUES (1), (2)) AS v(i)""")
def topic_model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model published twice is one version; one with a cluster less becomes the next. Clusters are those read back."""
    means = saved(V.means(_unit(spark, sf_dir), "label").select((F.row_number().over(Window.orderBy("label")) - 1).alias("cluster"), F.col("mean").alias("v"), "n"), "label-means")  # a row a label
    topics = lambda rows: rows.select("cluster", F.concat(F.lit("topic "), "cluster").alias("label"), F.lit(1.0).alias("share"), F.col("n").alias("size"))
    store = O.ModelStore(spark, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    whole, less = means, means.where(F.col("cluster") < means.count() - 1)
    for rows in (whole, whole, less):
        store.publish({"centroids": rows.select("cluster", "v"), "topics": topics(rows)})
    sizes = [(v, store.load(v)["centroids"].count()) for v in (1, 2)]
    return store.versions().join(F.broadcast(spark.createDataFrame(sizes, "version int, clusters long")), "version").select("version", "clusters", "is_active")


@reg.add("""SELECT lang, count(*) AS n, count(DISTINCT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS distinct_texts, count(*) FILTER (doc_id IN (SELECT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))) AS overlapping FROM documents GROUP BY lang""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal normalized texts, and documents that hold a passage of another corpus word for word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("passage"))
    hit = A.holding(d.select("doc_id", "text"), passages).select("doc_id").distinct().withColumn("_o", F.lit(1))
    return d.join(hit, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.md5(J.prefix_key(F.col("text"), 1 << 30))).alias("distinct_texts"), F.count("_o").alias("overlapping"))


@reg.add(r"""WITH w AS (SELECT doc_id AS id, lang AS grp, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
s AS (SELECT DISTINCT id, grp, g FROM (SELECT id, grp, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS x FROM s a JOIN s b ON a.grp = b.grp AND a.g = b.g AND a.id <> b.id GROUP BY ALL),
j AS (SELECT a AS id, max(x / (u.n + v.n - x)) AS j FROM p JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE x / (u.n + v.n - x) >= 0.5 GROUP BY a)
SELECT grp, count(*) AS n, count(j) AS near, round(max(j), 6) AS greatest FROM w LEFT JOIN j USING (id) GROUP BY grp""")
def near_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, the documents with a near copy and the greatest five-word Jaccard."""
    return A.near_duplicate_audit(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text"))


_LAYERS = """d AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'synthetic' ELSE 'real' END AS origin, lang AS language, source AS t, n_chars // 1000 AS p FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
y AS (SELECT CASE WHEN GROUPING(language) = 0 THEN 'cell' WHEN GROUPING(origin) = 0 THEN 'layer' ELSE 'mixed' END AS level, coalesce(origin, '') AS origin, coalesce(language, '') AS language, t, p, count(*) AS n FROM d GROUP BY GROUPING SETS ((origin, t, p), (t, p), (origin, language, t, p))),
a AS (SELECT level, origin, language, sum(n) AS total, sum(n * (n - 1) / 2) AS both_ FROM y GROUP BY ALL),
f AS (SELECT level, origin, language, sum(c * (c - 1) / 2) AS in_f, sum(m) AS pure FROM (SELECT level, origin, language, p, sum(n) AS c, max(n) AS m FROM y GROUP BY ALL) GROUP BY ALL),
w AS (SELECT level, origin, language, sum(r * (r - 1) / 2) AS in_t FROM (SELECT level, origin, language, t, sum(n) AS r FROM y GROUP BY ALL) GROUP BY ALL),
s AS (SELECT level, origin, language, round(pure / total, 6) AS purity, round(CASE WHEN (in_t + in_f) / 2 = in_t * in_f / greatest(total * (total - 1) / 2, 1) THEN 1 ELSE (both_ - in_t * in_f / greatest(total * (total - 1) / 2, 1)) / ((in_t + in_f) / 2 - in_t * in_f / greatest(total * (total - 1) / 2, 1)) END, 6) AS ari, total::BIGINT AS n FROM a JOIN f USING (level, origin, language) JOIN w USING (level, origin, language))
SELECT level, origin, language, round(purity, 4) AS purity, round(ari, 4) AS ari, n FROM s
UNION ALL SELECT 'mean', origin, '', round(avg(purity), 4), round(avg(ari), 4), sum(n)::BIGINT FROM s WHERE level = 'cell' GROUP BY origin
UNION ALL SELECT 'gap', '', language, round(min_by(purity, origin) - max_by(purity, origin), 4), round(min_by(ari, origin) - max_by(ari, origin), 4), sum(n)::BIGINT FROM s WHERE level = 'cell' GROUP BY language HAVING count(*) > 1"""


@reg.add(f"WITH {_LAYERS}")
def layer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a clustering by origin, over all, by origin and language, with means and gaps; labelled documents stand for real ones."""
    real = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_r", F.lit(True))
    d = table(spark, sf_dir, "documents").join(real, "doc_id", "left")
    rows = d.select(F.when(F.col("_r"), "real").otherwise("synthetic").alias("origin"), F.col("lang").alias("language"), F.col("source").alias("t"), F.expr("n_chars div 1000").alias("p"))
    return A.layer_reports(rows, "t", "p").select("level", "origin", "language", F.round("purity", 4).alias("purity"), F.round("ari", 4).alias("ari"), "n")


def _with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with topic, language, origin and split of the documents with their ids."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "real").otherwise("synthetic").alias("origin"))
    h = F.pmod(F.xxhash64("id"), F.lit(10))
    split = F.when(h < 6, "train").when(h < 8, "validation").otherwise("test")
    return saved(_unit(spark, sf_dir).withColumnRenamed("label", "topic").join(d, "id").withColumn("split", split), "vectors-with-facts")


@reg.add()
def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of the vectors and numbers of clusters, scored by topic and language, with the chosen one marked."""
    grid, (drop, keep, k) = X.search_projection(_with_facts(spark, sf_dir), [0, 1], [8, 16], [4, 8], n_init=2)
    return grid.withColumn("chosen", (F.col("drop") == drop) & (F.col("keep") == keep) & (F.col("k") == k))


@reg.add()
def run_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ways to centre or split before clustering, in up to three regimes of k, with the winner marked."""
    results, winner = X.run_variants(_with_facts(spark, sf_dir), 12, [2, 4], n_init=2)
    return results.withColumn("winner", F.col("variant") == winner)


@reg.add("SELECT count(*) AS filled, 0::BIGINT AS filled_again, count(*) AS under_next_version, count(*) FILTER (quality = 1) AS replaced FROM (SELECT DISTINCT vec_id, max(quality) AS quality FROM embeddings LEFT JOIN labels ON doc_id = vec_id GROUP BY vec_id)")
def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector store filled from the table: a second fill makes nothing, a new version starts empty, and vectors of good documents are replaced."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string"))).alias("text"))
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"

    def embed(batches):
        for b in batches:
            yield b.assign(v=[[float(x) for x in t.split()] for t in b["text"]])[["id", "v"]]

    store = O.VectorStore(spark, path, "table", 1)
    counts = [store.fill(rows, embed), store.fill(rows, embed), O.VectorStore(spark, path, "table", 2).missing(rows).count()]
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    store.upsert(store.vectors().join(good, "id").select("id", F.transform("v", lambda x: -x).alias("v")))
    first = store.fetch(rows.select("id").distinct().withColumn("place", F.col("id"))).withColumnRenamed("v", "now").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    replaced = first.where(F.col("now")[0] == -F.col("embedding")[0]).count()
    return spark.createDataFrame([(*counts, replaced)], "filled long, filled_again long, under_next_version long, replaced long")
