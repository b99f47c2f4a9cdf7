"""Periodic runs against every stretch and period of small texts, and the query against the same on its tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24):
    """All maximal stretches by lag; a stretch counts under its smallest period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 3 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(11)
    few, many = "ab", [f"w{i}" for i in range(400)]
    out = [None, "", " \n\t ", "one", "x " * 23, "x " * 24, "x " * 5000, "a b " * 2000, "a a b " * 12 + "a a c " * 12]
    for _ in range(250):
        out.append(" ".join(rng.choice(few) for _ in range(rng.randrange(20, 120))))
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            block = [rng.choice(many[: rng.choice((2, 3, 400))]) for _ in range(rng.randrange(1, 90))]
            parts += [*[rng.choice(many) for _ in range(rng.randrange(0, 30))], *(block * rng.randrange(1, 6))[: rng.randrange(10, 400)]]
        out.append("\n".join(parts))
    a, b = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(30)]
    for unit in (a + a + b + b, a + b + a + b + b, a + a + a + b):  # every gram of a unit occurs more than once in it
        out.append(" ".join((unit * 4)[5:-7]))
    shared = [f"s{i}" for i in range(33)]
    out.append(" ".join((shared + ["x"] + shared + ["x"] + shared + ["y"]) * 5))
    return out


def test_runs_equal_all_stretches(spark):
    rows = list(enumerate(texts())) + [(None, "a b c " * 9), (7, "a " * 30), (7, "a " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("Collapsed", F.lit(1)).repartition(5)
    out = periodic_runs.collapse(docs).collect()
    assert len(out) == len(rows)
    expected = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        runs = plain_runs(w)
        expected.setdefault(i, []).append((len(w), runs, plain_kept(w, runs)))
    assert sum(bool(x[1]) for v in expected.values() for x in v) > 100
    for r in out:
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) in expected[r.doc_id]
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least", [9, 10, 40])
def test_other_least_lengths(spark, least):
    rng = random.Random(least)
    rows = [(i, " ".join(rng.choice("abc"[: rng.choice((2, 3))]) for _ in range(200))) for i in range(60)] + [(99, "a b c d e f g h i j k l m " * 9)]
    for r in periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string"), least).collect():
        assert [tuple(x) for x in r.runs] == plain_runs(rows[r.doc_id if r.doc_id < 60 else 60][1].split(), least)


def test_bands_guarantee_their_grams():
    for least in range(9, 60):
        lags = []
        for lo, hi, k in periodic_runs.bands(least, 4000):
            lags += range(lo, hi)
            for q in range(lo, hi):
                assert k <= max(least - q, 2 * q)  # no run of the band lacks such a gram
                assert (q - 1) // (k - q + 1) < periodic_runs.NEXT  # occurrences before the one a period away
        assert lags == list(range(1, lags[-1] + 1)) and lags[-1] >= 1333


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 7 else " ".join(rng.choice(("la", "lo", "mé", "x,")) if i % 3 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 200)))) for i in range(400)]
    rows += [(None, "a " * 50), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (said, plain_kept(w, runs)))))
    out = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in out) > 10
