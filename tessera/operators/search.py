"""Searches over model settings: projections before clustering, and variants of centring and splitting. Grids are driver loops over fits that share
their passes; documents stay distributed, and each setting is scored from summed contingency counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.sources.tables import saved

# Differences of scores that count as none.
ARI_TIE, LANGUAGE_TIE = 0.015, 0.01

GRID = "drop int, keep int, k int, ari double, ari_language double"
VARIANTS = {  # name: (centred by, split by)
    "baseline": ((), ()),
    "per_language": ((), ("language",)),
    "centered_language": (("language",), ()),
    "centered_origin": (("origin",), ()),
    "centered_cell": (("language", "origin"), ()),
    "per_cell": ((), ("language", "origin")),
}
RESULTS = "variant string, regime string, strata int, clusters int, ari double, purity double"


def better(a: tuple[float, float], b: tuple[float, float] | None) -> bool:
    """Whether (ari, ari_language) of a setting beats the best so far: clearly by topic, or as good by topic and clearly less tied to language."""
    if b is None or a[0] > b[0] + ARI_TIE:
        return True
    return abs(a[0] - b[0]) <= ARI_TIE and abs(a[1]) < abs(b[1]) - LANGUAGE_TIE


def search_projection(rows: DataFrame, drops: list[int], keeps: list[int], ks: list[int], seed: int = 42, n_init: int = 10) -> tuple[DataFrame, tuple[int, int, int]]:
    """rows (id, v, topic, language, split) to the scored grid (GRID) and the chosen (drop, keep, k).

    Axes come from one covariance pass over the training rows. The unit vectors of every cell, a (drop, keep), are stored once, with zeros up to the
    widest keep, and all k of all cells are fitted together. Scores are those of the validation rows by topic and of all others by language. Cells are
    taken in order of drop, keep, k, and the best so far gives way by `better`."""
    mean, axes, _ = V.pca_fit(rows.where("split = 'train'").select("v"))
    most = min(max(drops) + max(keeps), len(axes))
    cells = [(drop, keep) for drop in sorted(set(drops)) for keep in sorted(set(keeps)) if drop + keep <= len(axes)]
    if not cells:
        return rows.sparkSession.createDataFrame([], GRID), (0, 0, 0)
    widest = max(keep for _, keep in cells)
    along = V.pca_coordinates(rows, mean, axes[:most])
    unit = lambda drop, keep: F.concat(V.l2_normalize(F.slice("coordinates", drop + 1, keep)), F.array_repeat(F.lit(0.0), widest - keep))
    of_cell = F.explode(F.array(*[F.struct(F.lit(i).alias("stratum"), unit(*cell).alias("v")) for i, cell in enumerate(cells)])).alias("c")
    every = saved(along.select("id", "topic", "language", "split", of_cell).select("id", "topic", "language", "split", "c.*"), "projected")
    ks = sorted(set(ks))
    fits = V.kmeans_strata(every.where("split = 'train'").select("id", "v", "stratum"), {i: ks for i in range(len(cells))}, seed, n_init)
    used = [(i, k) for i in range(len(cells)) for k in ks]
    held = every.where("split <> 'train'").select("v", "topic", "language", "split", "stratum")
    labelled = saved(V.labels_of(held, [fits[x][0] for x in used], [i for i, _ in used]), "projected-labels")
    topic = {r["fit"]: r["ari"] for r in V.contingency_scores(labelled.where("split = 'validation'"), "topic", "label", "fit").collect()}  # a row a fit
    language = {r["fit"]: r["ari"] for r in V.contingency_scores(labelled.where("split <> 'validation'"), "language", "label", "fit").collect()}
    found, best, chosen = [], None, (0, 0, 0)
    for n, (i, k) in enumerate(used):
        score = (topic.get(n, 0.0), language.get(n, 0.0))
        found.append((*cells[i], k, *map(float, score)))
        if better(score, best):
            best, chosen = score, (*cells[i], k)
    return rows.sparkSession.createDataFrame(found, GRID), chosen


def _strata(rows: DataFrame, by: tuple[str, ...]) -> list[tuple[dict[str, str], int]]:
    """(values, number of topics) of the strata of the training rows; few, and in order."""
    if not by:
        return [({}, rows.select("topic").distinct().count())]
    return [({c: r[c] for c in by}, r["n"]) for r in rows.groupBy(*by).agg(F.count_distinct("topic").alias("n")).orderBy(*by).collect()]


def _shared_clusters(topics: list[int], matched: int) -> list[int]:
    """matched clusters dealt to strata in proportion to their topics, two at least."""
    return [max(2, round(matched * n / sum(topics))) for n in topics]


def run_variants(rows: DataFrame, matched: int, ks: list[int], seed: int = 42, n_init: int = 10) -> tuple[DataFrame, str]:
    """rows (id, v, topic, language, origin, split) to RESULTS by variant and regime, and the name of the winner.

    Regimes: true_k, as many clusters in a stratum as it has topics; selected_k, the k of ks with the best silhouette there; matched, `matched` clusters
    in all, left out where true_k has that many. The vectors of all variants are stored once, and all fits of all variants share their passes. Group means come from training rows; groups they lack use the mean of all. Test rows are scored over all strata. The winner has the
    highest ARI at true_k, rounded to six digits, then the fewest strata."""
    train = rows.where("split = 'train'")
    ways, parts, true = [], [], []  # (name, first stratum, strata); rows; clusters of each stratum that has as many as topics
    for name, (center, split) in VARIANTS.items():
        own = V.centered_by(rows, train, center) if center else rows.withColumn("v", V.l2_normalize(F.col("v")))
        strata = _strata(train, split)
        which = lambda values: reduce(lambda a, c: a & F.col(c).eqNullSafe(values[c]), values, F.lit(True))
        number = F.coalesce(*[F.when(which(values), len(true) + i) for i, (values, _) in enumerate(strata)])  # null: a stratum that training rows lack
        parts.append(own.withColumn("stratum", number).where("stratum IS NOT NULL").select("id", "v", "topic", "split", "stratum"))
        ways.append((name, len(true), len(strata)))
        true += [max(n, 2) for _, n in strata]
    every = saved(reduce(DataFrame.unionByName, parts), "variants")
    here = every.where("split = 'train'").select("id", "v", "stratum")
    size = {r["stratum"]: r["count"] for r in here.groupBy("stratum").count().collect()}  # a row a stratum
    grids = [[k for k in ks if k < size[i]] or [1] for i in range(len(true))]
    regimes = {}  # clusters of the strata, by variant and regime
    for name, a, n in ways:
        own_true = true[a : a + n]
        regimes |= {(name, "true_k"): own_true} | ({(name, "matched"): _shared_clusters(own_true, matched)} if sum(own_true) != matched else {})
    wanted = {i: set(grid) for i, grid in enumerate(grids)}
    first = {name: a for name, a, _ in ways}
    for (name, _), of in regimes.items():
        for i, k in enumerate(of, first[name]):
            wanted[i].add(k)
    fits = V.kmeans_strata(here, {i: sorted({min(k, size[i]) for k in of}) for i, of in wanted.items()}, seed, n_init)
    rivals = [(i, k) for i, grid in enumerate(grids) for k in grid if len(grid) > 1]
    score = dict(zip(rivals, V.silhouettes(here, [fits[x][0] for x in rivals], [i for i, _ in rivals]), strict=True))
    for name, a, n in ways:
        regimes[name, "selected_k"] = [grids[i][0] if len(grids[i]) == 1 else max(grids[i], key=lambda k: (score[i, k], -k)) for i in range(a, a + n)]
    used = sorted({(i, min(k, size[i])) for (name, _), of in regimes.items() for i, k in enumerate(of, first[name])})
    test = every.where("split = 'test'").select("v", "topic", F.col("stratum").cast("int").alias("stratum"))
    labelled = saved(V.labels_of(test, [fits[x][0] for x in used], [i for i, _ in used]), "variant-labels")
    named = [(used.index((i, min(k, size[i]))), name, regime) for (name, regime), of in regimes.items() for i, k in enumerate(of, first[name])]
    found = labelled.join(F.broadcast(rows.sparkSession.createDataFrame(named, "fit int, variant string, regime string")), "fit")  # a row a fit and regime
    found = found.select("variant", "regime", "topic", F.concat_ws(":", F.col("stratum").cast("string"), F.col("label").cast("string")).alias("cluster"))
    scores = V.contingency_scores(found, "topic", "cluster", "variant", "regime").collect()  # a row a variant and regime
    strata_of = {name: n for name, _, n in ways}
    made = [(r["variant"], r["regime"], strata_of[r["variant"]], sum(regimes[r["variant"], r["regime"]]), float(r["ari"]), float(r["purity"])) for r in scores]
    made.sort(key=lambda r: (list(VARIANTS).index(r[0]), r[1]))
    at_true = [(round(r[4], 6), -r[2], r[0]) for r in made if r[1] == "true_k"]
    winner = max(at_true, key=lambda x: x[:2])[2] if at_true else ""
    return rows.sparkSession.createDataFrame(made, RESULTS), winner
