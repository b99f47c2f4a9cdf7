"""Sharding: every row once, bytes near equal, gapless slots, copies together unless they fill a range."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, sharding


def shards_of(spark, rows, tmp_path, n=16, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema).repartition(4)
    path = f"{tmp_path}/shards"
    sharding.write_shards(docs, path, n)
    return sharding.read_shards(spark, path, docs.schema).collect()


def size(text):
    return len((text or "").encode()) + 1


def check(rows, out, n, slack):
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    total = [0] * n
    for s in range(n):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        total[s] = sum(size(r.text) for r in own)
    mean = sum(total) / n
    assert all(abs(t - mean) <= slack + 0.01 * mean for t in total), total


def test_ranges_rank_as_tuples_do():
    rng = random.Random(1)
    few = lambda: (rng.randrange(4), rng.randrange(4), rng.randrange(5))
    bounds = sorted({few() for _ in range(30)})
    keys = [few() for _ in range(500)]
    got = sharding.Ranges(np.array(bounds, np.int64)).of(*np.array(keys, np.int64).T)
    assert got.tolist() == [bisect.bisect_right(bounds, k) for k in keys]
    assert sharding.Ranges(np.zeros((0, 3), np.int64)).of(*np.array(keys, np.int64).T).max() == 0


def test_sizes_are_near_equal(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcé ☃") for _ in range(int(rng.paretovariate(1.2) * 20)))[:20000]) for i in range(6000)]
    rows += [(10_000 + i, rows[7][1]) for i in range(5)] + [rows[3]] * 3 + [(None, "no id"), (None, None), (9_999, "")]
    out = shards_of(spark, rows, tmp_path)
    check(rows, out, 16, 2 * max(size(t) for _, t in rows))
    of = {}
    for r in out:
        of.setdefault(r.text, set()).add(r.shard)
    assert len(of[rows[7][1]]) == 1 or size(rows[7][1]) * 6 > 0.002 * sum(size(t) for _, t in rows) / 16


@pytest.mark.parametrize("kind", ["copies", "repeated rows", "one long"])
def test_overfull_ranges_are_cut(spark, tmp_path, kind):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(40))) for i in range(2000)]
    same = " ".join(["copy"] * 60)
    if kind == "copies":
        rows += [(5000 + i, same) for i in range(2500)]
    elif kind == "repeated rows":
        rows += [(5000, same)] * 2500
    else:
        rows += [(5000, "x" * 400_000)]
    out = shards_of(spark, rows, tmp_path)
    if kind != "one long":
        check(rows, out, 16, 2 * size(same))
    else:
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        alone = next(r.shard for r in out if r.doc_id == 5000)
        others = Counter()
        for r in out:
            others[r.shard] += size(r.text)
        rest = [v for s, v in others.items() if s != alone]
        assert all(r.slot < len(out) for r in out) and max(rest) < 1.02 * sum(others.values()) / 16


def test_few_rows_none_and_clashing_columns(spark, tmp_path):
    rows = [(3, "abc", 1, "s", 2), (1, None, 2, "t", 3), (3, "abc", 1, "s", 2)]
    out = shards_of(spark, rows, tmp_path / "few", schema="doc_id long, text string, shard int, _place string, Slot int")
    assert sorted(((r.doc_id, r.text, r._place) for r in out), key=str) == sorted(((r[0], r[1], r[3]) for r in rows), key=str)
    assert {r.shard for r in out} <= set(range(16))
    assert shards_of(spark, [], tmp_path / "none") == []


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, None if i % 90 == 5 else " ".join(f"é{rng.randrange(500)}" for _ in range(rng.randrange(0, 90)))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_sharding(spark, str(tmp_path)).collect()
    assert [c for c in out[0].asDict()] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == sorted((i, size(t), zlib.crc32((t or "").encode()), "bytes", None) for i, t in rows)
    total = np.zeros(16)
    for r in out:
        total[r.shard] += r.size
    assert total.max() - total.min() < 0.02 * total.mean() and len({(r.shard, r.slot) for r in out}) == len(rows)


