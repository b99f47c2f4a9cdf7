"""Vector, clustering and cluster-quality jobs over embeddings; vec_id is the document, label its topic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.operators.topics import best_k
from tessera.plans.registry import Registry, table
from tessera.sources.tables import saved

reg = Registry()
K = 8


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).withColumn("v", V.l2_normalize(F.col("v")))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors in the shared folder, for fits that read them again and again."""
    return saved(_unit(spark, sf_dir), "unit-vectors")


def _seeds(rows: DataFrame) -> np.ndarray:
    """The K rows of smallest id: a fixed start."""
    return np.array([r["v"] for r in rows.orderBy("id").limit(K).collect()])


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_N = f"{_E}, n AS (SELECT id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e), u AS (SELECT id, label, CASE WHEN l = 0 THEN v ELSE list_transform(v, lambda x: x / l) END AS v FROM n)"
_A = f"{_N}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, v AS w FROM (SELECT * FROM u ORDER BY id LIMIT {K})), d AS (SELECT id, label, cluster, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) ** 2)) AS d FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM d), a AS (SELECT id, label, max(CAST(cluster AS INT)) FILTER (r = 1) AS cluster, max(d) FILTER (r = 1) AS cost, 1 - sqrt(max(d) FILTER (r = 1)) / sqrt(max(d) FILTER (r = 2)) AS margin FROM r GROUP BY id, label)"
_SUM = "round(list_sum(v), 4) AS total, round(v[1], 4) AS first"


@reg.add(f"WITH {_N} SELECT id, {_SUM} FROM u")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("v")[0], 4).alias("first"))


@reg.add(f"WITH {_E} SELECT id, CASE WHEN id % 9 = 0 THEN 'absent' WHEN id % 7 = 0 THEN 'width' END AS why FROM e WHERE id % 9 = 0 OR id % 7 = 0")
def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.slice("v", 1, 3)).otherwise(F.col("v")).alias("v"))
    return V.validate_vectors(rows)


_POOL = "SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM e, range(1, 4096) t(i) WHERE i <= len(v) GROUP BY label, i"


@reg.add(f"WITH {_E}, m AS ({_POOL}) SELECT label, max(n) AS n, round(sum(x), 4) AS total FROM m GROUP BY label")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_pool(_rows(spark, sf_dir), "label").select("label", "n", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@reg.add(f"WITH {_E}, m AS ({_POOL}), g AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label), c AS (SELECT id, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM e JOIN g USING (label)), l AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM c) SELECT id, round(CASE WHEN l < 1e-9 THEN 0 ELSE v[1] / l END, 4) AS first FROM l")
def group_centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.center_by_group(_rows(spark, sf_dir), "label")
    return out.select("id", F.round(F.when(V.norm(F.col("v")) < 0.5, 0.0).otherwise(F.col("v")[0]), 4).alias("first"))


@reg.add(f"WITH {_A} SELECT id, cluster, round(cost, 4) AS cost, round(margin, 3) AS margin FROM a")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.assign_nearest(rows, _seeds(rows)).select("id", "cluster", F.round("cost", 4).alias("cost"), F.round("margin", 3).alias("margin"))


@reg.add(f"WITH {_A} SELECT round(quantile_cont(margin, 0.1), 4) AS threshold FROM a")
def margin_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.margin_threshold(V.assign_nearest(rows, _seeds(rows))).select(F.round("threshold", 4).alias("threshold"))


@reg.add(f"WITH {_A}, t AS (SELECT quantile_cont(margin, 0.1) AS t FROM a) SELECT id, CASE WHEN margin >= t - 1e-9 THEN cluster END AS cluster, CASE WHEN margin >= t - 1e-9 THEN 'assigned' ELSE 'unclear' END AS outcome FROM a, t")
def assign_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest topic, refused where the margin is under the threshold."""
    rows = _unit(spark, sf_dir)
    found = V.assign_nearest(rows, _seeds(rows))
    ok = F.col("margin") >= F.col("threshold") - 1e-9
    return found.join(F.broadcast(V.margin_threshold(found))).select("id", F.when(ok, F.col("cluster")).alias("cluster"), F.when(ok, "assigned").otherwise("unclear").alias("outcome"))


@reg.add(f"WITH {_A} SELECT cluster, count(*) AS n, round(sum(cost), 3) AS inertia FROM a GROUP BY cluster")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.assign_nearest(rows, _seeds(rows)).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("inertia"))


@reg.add()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means, the best of ten seeded starts, with cluster of every row."""
    rows = stored(spark, sf_dir)
    centroids, _, _ = V.kmeans_best(rows, [K], seed=1)[K]
    return V.assign_nearest(rows, centroids).select("id", "cluster", "cost", "margin")


@reg.add()
def k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k against inertia and silhouette, with the best k by silhouette and the elbow (farthest from the chord on rescaled axes) marked."""
    return k_grid(stored(spark, sf_dir), [*range(2, 13)], seed=1)


def k_grid(rows: DataFrame, ks: list[int], seed: int, n_init: int = 10) -> DataFrame:
    """(k, inertia, silhouette, n_iter, best, elbow), all k and starts fitted together; best is the smallest k of highest silhouette."""
    fits = V.kmeans_best(rows, ks, seed, n_init)
    scores = V.silhouettes(rows.withColumn("stratum", F.lit(0)), [c for c, _, _ in fits.values()], [0] * len(fits))
    made = [(k, cost, s, steps) for (k, (_, cost, steps)), s in zip(fits.items(), scores, strict=True)]
    grid = elbow(rows.sparkSession.createDataFrame(made, "k int, inertia double, silhouette double, n_iter int"))
    return grid.join(F.broadcast(best_k(grid).select("k", F.lit(True).alias("best"))), "k", "left").withColumn("best", F.coalesce("best", F.lit(False)))


def elbow(grid: DataFrame) -> DataFrame:
    """grid (k, inertia, ...) with elbow true for the k farthest from the chord; a grid is a few rows."""
    lo, hi = grid.agg(F.min("k"), F.max("k"), F.min("inertia"), F.max("inertia")), None
    lo = lo.toDF("k0", "k1", "i0", "i1")
    x = (F.col("k") - F.col("k0")) / F.greatest(F.col("k1") - F.col("k0"), F.lit(1))
    y = (F.col("inertia") - F.col("i0")) / F.greatest(F.col("i1") - F.col("i0"), F.lit(1e-12))
    out = grid.join(F.broadcast(lo)).withColumn("gap", F.abs(x + y - 1))
    return out.withColumn("elbow", F.row_number().over(Window.orderBy(F.desc("gap"), "k")) == 1).drop("k0", "k1", "i0", "i1", "gap")


@reg.add()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axes after the first, as unit vectors."""
    rows = _rows(spark, sf_dir)
    mean, axes, _ = V.pca_fit(rows)
    return V.pca_project(rows, mean, axes, 1, 8).select("id", "projected")


@reg.add(f"WITH {_E}, m AS (SELECT label % 2 = 0 AS s, i, avg(v[i]) AS x FROM e, range(1, 4096) t(i) WHERE i <= len(v) GROUP BY ALL), d AS (SELECT a.i, a.x - b.x AS x FROM m a JOIN m b ON a.i = b.i AND a.s AND NOT b.s) SELECT i - 1 AS place, round(x / (SELECT sqrt(sum(x * x)) FROM d), 4) AS x FROM d")
def contrast_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.contrast_direction(_rows(spark, sf_dir), F.col("label") % 2 == 0)
    return d.select(F.posexplode("direction").alias("place", "x")).select(F.col("place").cast("long").alias("place"), F.round("x", 4).alias("x"))


_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS p FROM u) JOIN (SELECT label, greatest(2, round(2000 * count(*) / sum(count(*)) OVER ())) AS take FROM u GROUP BY label) USING (label) WHERE p <= take)"


@reg.add(f"WITH {_N}, {_S} SELECT id, label FROM s")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stratified_sample(_unit(spark, sf_dir), "label", 2000).select("id", "label")


@reg.add(f"""WITH {_N}, {_S}, z AS (SELECT label, count(*) AS size FROM s GROUP BY label), p AS (SELECT a.id, a.label, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda q: (q[1] - q[2]) ** 2)))) AS t FROM s a, s b GROUP BY ALL),
m AS (SELECT p.id, p.label, max(CASE WHEN other = p.label AND size > 1 THEN t / (size - 1) END) AS a, min(CASE WHEN other <> p.label THEN t / size END) AS b FROM p JOIN z ON z.label = other GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS s FROM m GROUP BY label""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette per topic over a stratified sample of 2000."""
    sample = V.stratified_sample(_unit(spark, sf_dir), "label", 2000).select("id", "v", "label")
    return V.silhouette_samples(sample).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("s"))


_ARI = """x AS (SELECT {by} t, p, count(*) AS n FROM {src} GROUP BY ALL), a AS (SELECT {by} sum(n) AS total, sum(n * (n - 1) / 2) AS both_ FROM x GROUP BY ALL), f AS (SELECT {by} sum(c * (c - 1) / 2) AS in_f, sum(m) AS pure, count(*) AS clusters FROM (SELECT {by} p, sum(n) AS c, max(n) AS m FROM x GROUP BY ALL) GROUP BY ALL),
w AS (SELECT {by} sum(r * (r - 1) / 2) AS in_t, count(*) AS classes FROM (SELECT {by} t, sum(n) AS r FROM x GROUP BY ALL) GROUP BY ALL)
SELECT {by} round(pure / total, 6) AS purity, round(CASE WHEN (in_t + in_f) / 2 = in_t * in_f / greatest(total * (total - 1) / 2, 1) THEN 1 ELSE (both_ - in_t * in_f / greatest(total * (total - 1) / 2, 1)) / ((in_t + in_f) / 2 - in_t * in_f / greatest(total * (total - 1) / 2, 1)) END, 6) AS ari, classes, clusters, CAST(total AS BIGINT) AS n FROM a {join}"""


@reg.add(f"WITH {_A}, y AS (SELECT label AS t, cluster AS p FROM a), " + _ARI.format(by="", src="y", join=", f, w").replace("a AS (SELECT  sum", "aa AS (SELECT  sum").replace("FROM a , f", "FROM aa , f"))
def adjusted_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.contingency_scores(V.assign_nearest(rows, _seeds(rows)), "label", "cluster")


@reg.add("WITH y AS (SELECT lang, source AS t, n_chars // 1000 AS p FROM documents), " + _ARI.format(by="lang,", src="y", join="JOIN f USING (lang) JOIN w USING (lang)"))
def cell_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores for each language."""
    rows = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("t"), F.expr("n_chars div 1000").alias("p"))
    return V.contingency_scores(rows, "t", "p", "lang")


@reg.add(f"WITH {_A}, g AS (SELECT cluster, label, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT cluster, min_by(label, (-n, label)) AS topic, max(n) AS m, CAST(sum(n) AS BIGINT) AS size FROM g GROUP BY cluster) SELECT CAST(i AS INT) AS cluster, topic, round(m / size, 6) AS share, coalesce(size, 0) AS size FROM range(10) r(i) LEFT JOIN b ON b.cluster = i")
def dominant_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return V.dominant_topics(V.assign_nearest(rows, _seeds(rows)), "cluster", "label", 10)


@reg.add(f"""WITH {_N}, p AS (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda q: (q[1] - q[2]) ** 2)), 9), b.id) AS r FROM u a, u b WHERE a.id <> b.id AND a.id % 100 = 0)
SELECT round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS agreement, (SELECT round(sum((n / t) ** 2), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM u GROUP BY label)) AS chance FROM p WHERE r = 1""")
def neighbour_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the nearest other vector has the same topic (queries: ids divisible by 100), and the level of chance."""
    rows = _unit(spark, sf_dir)
    found = R.knn_search(rows, rows.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), 2).where("qid <> id")
    first = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    found = found.withColumn("r", first).where("r = 1").join(rows.select("id", "label"), "id").join(rows.select(F.col("id").alias("qid"), F.col("label").alias("own")), "qid")
    share = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy()))
    chance = share.agg(F.round(F.sum(F.pow(F.col("n") / F.col("t"), 2)), 6).alias("chance"))
    return found.agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("agreement")).join(chance)
