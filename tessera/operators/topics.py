"""Choosing, merging, naming and storing topic models. Grids and models are tables of a few rows; documents stay distributed."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.sources.tables import saved


def k_by_quality_floor(grid: DataFrame, share: float = 0.8) -> DataFrame:
    """grid (k, ari, silhouette): of the k whose ARI is at least share * best, the one of highest silhouette, then smallest k."""
    best = grid.agg(F.max("ari").alias("_b"))
    ok = grid.join(F.broadcast(best)).where(F.col("ari") >= share * F.col("_b")).drop("_b")
    return ok.orderBy(F.desc("silhouette"), "k").limit(1)


def best_k(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("silhouette"), "k").limit(1)


def merge_close_centroids(centroids: np.ndarray, sizes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(merged centroids, new cluster of each old one): the most similar pair above the threshold is merged by size, again and again."""
    c, n = [x.astype(np.float64) for x in centroids], list(map(float, sizes))
    owner = [[i] for i in range(len(c))]
    while len(c) > 1:
        unit = np.array([x / max(np.linalg.norm(x), 1e-300) for x in c])
        sim = np.triu(unit @ unit.T, 1) - np.tril(np.full((len(c), len(c)), 2.0))
        i, j = np.unravel_index(sim.argmax(), sim.shape)
        if sim[i, j] < cosine:
            break
        c[i] = (c[i] * n[i] + c[j] * n[j]) / max(n[i] + n[j], 1e-300)
        n[i] += n[j]
        owner[i] += owner[j]
        del c[j], n[j], owner[j]
    relabel = np.empty(len(centroids), np.int64)
    for new, old in enumerate(owner):
        relabel[old] = new
    return np.array(c), relabel


def search_merge(found: DataFrame, centroids: np.ndarray, truth: str, thresholds: list[float]) -> DataFrame:
    """found (cluster, truth) under fitted centroids to (threshold, merged, purity, ari): the scores of merging at each
    cosine of a grid. The driver holds k x k similarities; rows are summed by cluster and truth before they meet the grid."""
    sizes = np.zeros(len(centroids))
    for r in found.groupBy("cluster").count().collect():  # k rows
        sizes[r["cluster"]] = r["count"]
    maps = [(float(t), i, int(x)) for t in thresholds for i, x in enumerate(merge_close_centroids(centroids, sizes, t)[1])]
    grid = found.sparkSession.createDataFrame(maps, "threshold double, cluster int, merged int")
    scores = V.contingency_scores(found.join(grid, "cluster"), truth, "merged", "threshold")
    return scores.select("threshold", F.col("clusters").alias("merged"), "purity", "ari")


def stability(rows: DataFrame, k: int, rounds: int = 5, share: float = 0.8, n_init: int = 10) -> DataFrame:
    """ARI between models fitted on pairs of hashed samples, over the rows (id, v) both hold; one row per round. The fits of all samples share each pass."""
    inside = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) < int(1000 * share)
    of = F.explode(F.array_compact(F.array(*[F.when(inside(s), F.lit(s)) for s in range(2 * rounds)]))).alias("stratum")
    every = saved(rows.select("id", "v", of), "samples")
    fits = V.kmeans_strata(every, {s: [k] for s in range(2 * rounds)}, {s: s for s in range(2 * rounds)}, n_init)
    models = [fits[s, k][0] for s in range(2 * rounds)]
    labelled = V.labels_of(every, models, list(range(2 * rounds))).select("id", F.expr("fit div 2").cast("int").alias("round"), (F.col("fit") % 2).alias("side"), "label")
    side = lambda s, name: F.max(F.when(F.col("side") == s, F.col("label"))).alias(name)
    both = labelled.groupBy("round", "id").agg(side(0, "a"), side(1, "b")).where("a IS NOT NULL AND b IS NOT NULL")
    return V.contingency_scores(both, "a", "b", "round").select("round", "ari")


def fit_per_stratum(rows: DataFrame, stratum: str, k: int, n_init: int = 10, unseen: DataFrame | None = None) -> DataFrame:
    """A model per stratum (few strata), cluster ids offset so that they do not collide. Rows of `unseen` may not name a stratum
    that rows lacks: there is no model to assign them with, and ValueError names the strata."""
    if unseen is not None and (lacking := unseen.select(stratum).distinct().join(rows.select(stratum).distinct(), stratum, "left_anti").limit(20).collect()):
        raise ValueError(f"no model for {stratum}: {sorted(str(r[0]) for r in lacking)}")
    values = [r[0] for r in rows.select(stratum).distinct().orderBy(stratum).collect()]  # few
    if not values:
        return rows.withColumns({"cluster": F.lit(None).cast("int"), "cost": F.lit(None).cast("double"), "margin": F.lit(None).cast("double")})
    number = F.coalesce(*[F.when(F.col(stratum).eqNullSafe(x), i) for i, x in enumerate(values)])
    fits = V.kmeans_strata(rows.select("id", "v", number.alias("stratum")), {i: [k] for i in range(len(values))}, {i: i for i in range(len(values))}, n_init)
    out = [V.assign_nearest(rows.where(F.col(stratum).eqNullSafe(x)), fits[i, k][0]).withColumn("cluster", F.col("cluster") + i * k) for i, x in enumerate(values)]
    return reduce(DataFrame.unionByName, out)


def external_scores(rows: DataFrame, found: str, labels: list[str]) -> DataFrame:
    """Purity and ARI of one clustering against each of several label columns, in one pass."""
    flat = rows.select(found, F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])).alias("x"))
    return V.contingency_scores(flat.select(found, "x.label", "x.value"), "value", found, "label")


def cluster_breakdown(rows: DataFrame, cluster: str, topic: str, language: str) -> DataFrame:
    """Per cluster: size, dominant topic and language with their shares, and the number of topics."""
    def top(col: str) -> DataFrame:
        n = rows.groupBy(cluster, col).agg(F.count("*").alias("n"))
        return n.groupBy(cluster).agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias(col), F.round(F.max("n") / F.sum("n"), 6).alias(f"{col}_share"), F.sum("n").alias("size"), F.count("*").alias(f"{col}_count"))

    return top(topic).join(top(language).drop("size", f"{language}_count"), cluster)


def compose_labels(words: DataFrame, names: DataFrame, most: int = 2, prefix: int = 5) -> DataFrame:
    """names (cluster, rubric, share) and words (cluster, term, rank, at most a few per cluster) to (cluster, label).

    A rubric that names one cluster is its label; siblings add up to `most` words that no earlier sibling took (same first letters count as
    taken); a small share gives "mixed"; nothing gives #cluster. Families are a few ranked words, so a group is bounded."""
    count = F.count("*").over(Window.partitionBy("rubric"))
    rows = names.withColumn("siblings", count).join(words.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w")), "cluster", "left")

    def pick(g):
        taken, out = set(), []
        for r in g.sort_values("cluster").itertuples(index=False):
            terms = [x["term"] for x in r.w] if r.w is not None else []
            fresh = []
            for t in terms:
                if len(fresh) < most and t[:prefix] not in taken:
                    fresh.append(t)
                    taken.add(t[:prefix])
            if r.rubric is None or r.share < 0.25:
                label = ": ".join(["mixed", ", ".join(fresh)]) if fresh else f"#{r.cluster}"
            else:
                label = r.rubric if r.siblings == 1 or not fresh else f"{r.rubric}: {', '.join(fresh)}"
            out.append((r.cluster, label))
        import pandas as pd

        return pd.DataFrame(out, columns=["cluster", "label"])

    return rows.groupBy("rubric").applyInPandas(pick, "cluster int, label string")


def year_targeted(questions: DataFrame, docs: DataFrame, year: Column, name_year: Column) -> DataFrame:
    """(qid, doc_id): for the year in a question the first document whose name holds it."""
    q = questions.select("qid", year.alias("year")).where("year IS NOT NULL")
    d = docs.select("doc_id", name_year.alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.min("doc_id").alias("doc_id"))
    return q.join(d, "year").select("qid", "year", "doc_id")


def outcomes(docs: DataFrame, found: DataFrame, threshold: DataFrame) -> DataFrame:
    """docs (id, topic of before) with cluster, margin and outcome: skipped without a vector (not in found), unclear under the
    margin threshold (one row), else assigned."""
    out = docs.join(found.select("id", F.col("cluster").alias("_c"), "margin"), "id", "left").join(F.broadcast(threshold))
    ok = F.col("margin") >= F.col("threshold") - 1e-9
    kind = F.when(F.col("margin").isNull(), "skipped").when(ok, "assigned").otherwise("unclear")
    return out.withColumn("outcome", kind).withColumn("cluster", F.when(ok, F.col("_c"))).drop("_c", "threshold")


def reassign_counts(rows: DataFrame) -> DataFrame:
    """One row over outcomes(): documents by outcome, and assigned ones whose topic of before is another (stale)."""
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    stale = F.count_if((F.col("outcome") == "assigned") & F.coalesce(F.col("topic") != F.col("cluster"), F.lit(True)))
    return rows.agg(F.count("*").alias("documents"), of("assigned"), of("skipped"), of("unclear"), stale.alias("stale"))


def before_after(rows: DataFrame) -> DataFrame:
    """outcomes() by topic of before and after: how many documents moved so, and their mean margin."""
    return rows.where("outcome <> 'skipped'").groupBy(F.col("topic").alias("before"), F.col("cluster").alias("after")).agg(F.count("*").alias("n"), F.avg("margin").alias("margin"))


def model_digest(centroids: DataFrame) -> DataFrame:
    """One row: sha256 over the rows (cluster, v) of a model in order; a model is a few rows."""
    line = F.concat_ws("|", F.col("cluster").cast("string"), F.array_join(F.transform("v", lambda x: F.round(x, 6).cast("string")), ","))
    return centroids.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", line.alias("line")))), lambda s: s["line"]), "\n"), 256).alias("digest"))


def register_version(registry: DataFrame, digest: DataFrame) -> DataFrame:
    """registry (version, digest, is_active): unchanged if the active digest is the same, else a new active version."""
    known = registry.where("is_active").select(F.col("digest").alias("_d"))
    state = digest.join(known, F.col("digest") == F.col("_d"), "left").agg(F.max(F.col("_d").isNotNull()).alias("same"), F.first("digest").alias("digest"))
    top = registry.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    old = registry.join(F.broadcast(state.select("same"))).select("version", "digest", (F.col("is_active") & F.col("same")).alias("is_active"))
    new = state.where("NOT same").join(top).select((F.col("top") + 1).cast("int").alias("version"), "digest", F.lit(True).alias("is_active"))
    return old.unionByName(new)
