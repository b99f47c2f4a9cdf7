"""Projection search, variants, stores, order statistics, audits and stream jobs on small tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import relational as R
from tessera.operators import search as X
from tessera.operators import stores as O
from tessera.operators import vectors as V
from tessera.streaming import jobs as K


def test_better_follows_the_tie_rule():
    assert X.better((0.5, 0.9), None) and X.better((0.52, 0.9), (0.5, 0.1)) and not X.better((0.51, 0.2), (0.5, 0.2))
    assert X.better((0.49, 0.1), (0.5, 0.2)) and not X.better((0.48, 0.0), (0.5, 0.9)) and not X.better((0.5, -0.195), (0.5, 0.2))


def clouds(rng, n, shift=0.0):
    """Rows of four topics; the first axis is language, the next two topic, the rest noise."""
    out = []
    for i in range(n):
        topic, language = i % 4, ("ru", "tj")[i // 4 % 2]
        v = rng.normal(0, 0.05, 6)
        v[0] += 12 * (language == "tj")
        v[1:3] += [(0, 5)[topic % 2], (0, 5)[topic // 2]]
        out.append((i, v.tolist(), f"t{topic}", language, ("a", "b")[i // 8 % 2], ("train", "train", "validation", "test")[i // 16 % 4]))
    return out


SCHEMA = "id long, v array<double>, topic string, language string, origin string, split string"


def test_search_projection_drops_the_language_axis(spark):
    rows = spark.createDataFrame(clouds(np.random.default_rng(1), 256), SCHEMA)
    grid, chosen = X.search_projection(rows, [0, 1], [2], [2, 4], n_init=1)
    got = {(r["drop"], r["keep"], r["k"]): (r.ari, r.ari_language) for r in grid.collect()}
    assert set(got) == {(d, 2, k) for d in (0, 1) for k in (2, 4)}
    assert chosen == (1, 2, 4) and got[chosen][0] == 1.0 and abs(got[chosen][1]) < 0.05 and got[0, 2, 2][1] > 0.9


def test_cells_of_a_projection_share_their_passes(spark):
    rows = spark.createDataFrame(clouds(np.random.default_rng(1), 256), SCHEMA)
    alone = {tuple(r)[:3]: tuple(r) for drop in (0, 1) for keep in (1, 2) for r in X.search_projection(rows, [drop], [keep], [2, 4], n_init=1)[0].collect()}
    fits, starts = [], V.kmeanspp_starts
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(V, "kmeanspp_starts", lambda *a: (fits.append(a), starts(*a))[1])
        grid, _ = X.search_projection(rows, [0, 1], [1, 2], [2, 4], n_init=1)
    assert len(fits) == 1
    for r in grid.collect():
        assert tuple(r) == pytest.approx(alone[r["drop"], r["keep"], r["k"]])


def test_variants(spark):
    rows = spark.createDataFrame(clouds(np.random.default_rng(2), 512), SCHEMA)
    results, winner = X.run_variants(rows, 6, [2], n_init=1)
    got = {(r.variant, r.regime): r for r in results.collect()}
    assert {v for v, _ in got} == set(X.VARIANTS) and {r for _, r in got} == {"true_k", "selected_k", "matched"}
    assert got["centered_language", "true_k"].ari > 0.95 and got["baseline", "true_k"].ari < 0.9
    assert got["per_language", "true_k"].strata == 2 and got["per_cell", "true_k"].clusters == 16 and got["baseline", "matched"].clusters == 6
    assert winner == "centered_language"


def test_fits_of_strata_equal_fits_alone(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 * 10 + i % 2), float(i % 3)], i % 2) for i in range(90)], "id long, v array<double>, stratum int")
    both = V.kmeans_strata(rows, {0: [2, 3], 1: [3]}, 5, 2)
    for (s, k), (c, cost, _) in both.items():
        alone = V.kmeans_best(rows.where(F.col("stratum") == s), [k] if s else [2, 3], 5, 2)[k]
        assert np.allclose(c, alone[0]) and cost == pytest.approx(alone[1])


@pytest.mark.parametrize("few", [3, 50, 10_000])
def test_order_statistics(spark, few):
    rng = random.Random(few)
    data = {"a": [rng.random() for _ in range(500)], "b": [rng.choice((1.0, 2.0, 1e9, -5.0)) for _ in range(400)], "c": [7.0]}
    rows = spark.createDataFrame([(g, x) for g, v in data.items() for x in [*v, None]], "g string, x double").repartition(3)
    wanted = [(g, f"k{k}", k) for g, v in data.items() for k in {1, len(v) // 2 + 1, len(v)}]
    out = R.order_statistics(rows, "g", "x", spark.createDataFrame(wanted, "g string, name string, k long"), few=few, buckets=8).collect()
    assert sorted((r.g, r["name"], r.x) for r in out) == sorted((g, n, sorted(data[g])[k - 1]) for g, n, k in wanted)
    assert R.order_statistics(rows.limit(0), "g", "x", spark.createDataFrame([], "g string, name string, k long")).count() == 0


def test_margin_threshold_interpolates(spark):
    values = [random.Random(3).random() for _ in range(37)]
    rows = spark.createDataFrame([(x,) for x in [*values, None]], "margin double")
    assert V.margin_threshold(rows, 0.1).first().threshold == pytest.approx(float(np.quantile(values, 0.1)))
    assert V.margin_threshold(rows.where("margin > 2"), 0.1).first().threshold is None


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for n in (1, 3):
            w = list(b)
            for _ in range(n):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[1], "", None, " ", "one two"]
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(texts)]

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    s = [sets(t) for t in texts]
    want = {}
    for i, g, _ in rows:
        j = [len(s[i] & s[k]) / len(s[i] | s[k]) for k, h, _ in rows if h == g and k != i and s[i] and s[k]]
        want[i] = round(max(j), 9) if j and max(j) >= 0.4 else None
    docs = spark.createDataFrame(rows, "id long, grp string, text string")
    got = {r.id: r.nearest if r.nearest is None else round(r.nearest, 9) for r in A.nearest_in_group(docs, 0.4).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 20
    assert A.near_duplicate_audit(docs.limit(0)).count() == 0


def test_near_duplicates_over_tiles_and_buckets(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(300)}" for _ in range(40)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "zz"]) for b in base] + [" ".join(base[0])] * 5 + [None, "", "\u00c9T\u00c9 x", "\u00e9t\u00e9\tx"]
    docs = spark.createDataFrame([(f"d{i}", "g", t) for i, t in enumerate(texts)] + [("n1", None, texts[0]), ("n2", None, texts[0])], "id string, grp string, text string")
    whole = A.shingle_tiles(docs.coalesce(1))
    assert whole.count() == 1 and A.shingle_tiles(docs.coalesce(1), 1).count() <= len(texts) + 2  # sets stay together, no shingle is a row
    few = {r.id: r.nearest for r in A.nearest_in_group(docs.repartition(4), 0.5, 1, 2).collect()}
    assert few == {r.id: r.nearest for r in A.nearest_in_group(docs.coalesce(1)).collect()} and len(few) == len(texts) + 2
    assert all(few[f"d{i}"] == (1.0 if i == 0 or 24 <= i < 29 else 35 / 37) for i in range(29))
    assert few["n1"] is few["n2"] is few["d29"] is few["d30"] is None and few["d31"] == few["d32"] == 1.0


def test_tiles_are_written_and_handed_on_in_small_parts(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(1), F.lit(80_000)), lambda i: F.hex(F.xxhash64(i, "id") % 10**6))
    docs = spark.range(0, 64, 1, 1).select("id", F.lit("g").alias("grp"), F.array_join(words, " ").alias("text"))
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in A.shingle_tiles(docs).inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 35 << 20 and max(sizes) < 24 << 20  # whatever one task writes
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(A, "saved", lambda df, *a, f=A.saved, **k: (seen.append(spark.conf.get(key, None)), f(df, *a, **k))[1])
    before = spark.conf.get(key, None)
    assert A.nearest_in_group(docs.limit(2)).count() == 2 and len(seen) > 4
    assert all(x is not None and int(x) <= 4 << 20 for x in seen) and spark.conf.get(key, None) == before


def test_crowds_of_near_copies_are_compared_in_blocks_and_in_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    edited = lambda words, k: " ".join(f"z{rng.randrange(10**6)}" if i in set(rng.sample(range(60), k)) else w for i, w in enumerate(words))
    texts = [edited(bases[0], rng.randrange(3)) for _ in range(70)] + [edited(b, rng.randrange(3)) for b in bases[1:] for _ in range(12)]
    texts += [" ".join([*bases[0][:30], *bases[1][:30]])] * 2 + [" ".join([*bases[0][:40], *bases[2][:20]]), "", None]
    rows = [(i, "xy"[i % 40 == 0], t) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").split()) else set() for t in texts]
    want = {}
    for i, g, _ in rows:
        j = [len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for k, h, _ in rows if h == g and k != i and sets[i] and sets[k]]
        want[i] = max(j) if j and max(j) >= 0.5 else None
    docs, made = spark.createDataFrame(rows, "id long, grp string, text string").repartition(3), {}
    monkeypatch.setattr(A, "saved", lambda df, name, *a, f=A.saved, **k: made.setdefault(name, f(df, name, *a, **k)))
    for kind in ({"crowd": 32}, {"crowd": 2, "block": 2000}, {"crowd": 9, "block": 300}):
        made.clear()
        assert {r.id: r.nearest for r in A.nearest_in_group(docs, **kind).collect()} == want
        assert made["shingle-within"].count() > 30 and made["shingle-pairs"].count() < 70 * 69 / 2 / 4


def test_layer_reports(spark):
    rows = [("real", "ru", "a", 1), ("real", "ru", "b", 2), ("real", "tj", "a", 1), ("real", "tj", "b", 1), ("synthetic", "ru", "a", 1), ("synthetic", "ru", "a", 1)]
    out = {(r.level, r.origin, r.language): (r.purity, r.n) for r in A.layer_reports(spark.createDataFrame(rows, "origin string, language string, t string, p int"), "t", "p").collect()}
    assert out["cell", "real", "tj"] == (0.5, 2) and out["layer", "real", ""] == (0.75, 4) and out["mixed", "", ""][1] == 6
    assert out["mean", "real", ""] == (0.75, 4) and out["gap", "", "ru"] == (0.0, 4) and ("gap", "", "tj") not in out


def test_vector_store(spark, tmp_path):
    calls = []

    def embed(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [[float(len(t)), 1.0] for t in b["text"]]})

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id long, text string")
    store = O.VectorStore(spark, f"file://{tmp_path}/v", "m", 1)
    assert store.vectors().count() == 0 and store.fill(rows.limit(2), embed) == 2 and store.fill(rows, embed) == 1 and store.fill(rows, embed) == 0
    store.upsert(spark.createDataFrame([(1, [9.0, 9.0])], "id long, v array<double>"))
    ids = spark.createDataFrame([(3, 0), (1, 1)], "id long, place int")
    assert [(r.id, list(r.v)) for r in store.fetch(ids).orderBy("place").collect()] == [(3, [3.0, 1.0]), (1, [9.0, 9.0])]
    with pytest.raises(ValueError, match="no vector for ids"):
        store.fetch(spark.createDataFrame([(8, 0)], "id long, place int"))
    for bad in ([(4, [float("nan"), 1.0])], [(4, [1.0])], [(4, None)]):
        with pytest.raises(ValueError, match="finite"):
            store.upsert(spark.createDataFrame(bad, "id long, v array<double>"))
    assert O.VectorStore(spark, f"file://{tmp_path}/v", "other", 1).vectors().count() == 0 and O.VectorStore(spark, f"file://{tmp_path}/v", "m", 2).missing(rows).count() == 3 and not calls


def test_model_store(spark, tmp_path):
    def model(centroids, labels=None, **more):
        return {"centroids": spark.createDataFrame(list(enumerate(centroids)), O.TABLES["centroids"]), "topics": spark.createDataFrame([(i, f"t{i}", 1.0, 5) for i in (labels or range(len(centroids)))], O.TABLES["topics"])} | more

    store = O.ModelStore(spark, f"file://{tmp_path}/m")
    with pytest.raises(ValueError, match="no model"):
        store.load()
    means = spark.createDataFrame([("ru", [0.5, 0.5])], O.TABLES["means"])
    assert store.publish(model([[1.0, 0.0], [0.0, 1.0]], means=means)) == 1 and store.publish(model([[1.0, 0.0], [0.0, 1.0]])) == 1
    assert store.publish(model([[1.0, 0.0]])) == 2 and store.load(1)["means"].first()["key"] == "ru"
    assert [(r.version, r.is_active) for r in store.versions().orderBy("version").collect()] == [(1, False), (2, True)] and store.load()["centroids"].count() == 1
    for wrong in (model([[1.0, 0.0], [0.0]]), model([[1.0], [2.0]], [0]), model([[float("inf")]]), model([[1.0]], means=means)):
        with pytest.raises(ValueError):
            store.publish(wrong)
    assert store.publish(model([[3.0, 4.0]]), layout=O.FORMAT + 1) == 3
    with pytest.raises(ValueError, match="layout"):
        store.load()


def test_one_bad_vector_stops_no_other(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.1]), (2, [5.0, float("nan")]), (3, [1.0]), (4, None), (5, [5.0, 5.1]), (6, [2.5, 2.5])], "id long, v array<double>")
    out = {r.id: (r.cluster, r.error) for r in K.assign_or_error(rows, np.array([[0.0, 0.0], [5.0, 5.0]]), 0.1).collect()}
    assert out == {1: (0, None), 2: (None, "not finite"), 3: (None, "width"), 4: (None, "absent"), 5: (1, None), 6: (None, None)}


def test_leases_end_with_their_jobs(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[(1, t(0), "beat"), (2, t(0), "beat"), (3, t(0), "beat")], [(1, t(30), "finish"), (3, t(50), "beat"), (9, t(70), "beat")], [(9, t(500), "finish")], [(9, t(100_000), "beat")], [(9, t(100_001), "finish")], [(9, t(300_000), "finish")]]
    schema = spark.createDataFrame([], "job_id long, ts timestamp, kind string").schema
    made = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = K.lease_expiry_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 60, 3, 600)
        q = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: made.extend(df.collect())).start()
        q.awaitTermination()
    assert sorted((r.job_id, r.new_status) for r in made) == [(2, "queued"), (3, "queued")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
