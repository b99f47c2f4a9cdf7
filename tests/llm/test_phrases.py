"""Collocations against plain counting, and the sort against sorted lists."""

import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=3, least=10, top=2000, inside=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, w[i : i + m]] = max(held[lang, w[i : i + m]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * held[lang, w] >= inside * a:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    out.sort()
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for _, g in groupby(out, key=lambda x: x[0]) for i, (lang, score, a, p, l, r) in enumerate(g) if i < top]


def corpus(seed, n=300):
    rng = random.Random(seed)
    zipf = [f"{c}{i}" for i in range(60) for c in ("la", "Él", "x☃", "NO")]
    sets = ["new york city", "Ice cream", "the the the", "à la carte menu"]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 120)):
            w.append(rng.choice(sets) if rng.random() < 0.08 else zipf[min(int(rng.paretovariate(0.8)) - 1, len(zipf) - 1)])
        out.append(("".join(x + rng.choice((" ", " ", "  ", "\t", ", ", ". ", "\n", " \x0b", "\r\n")) for x in w), rng.choice(("en", "en", "en", "fr", None, "und", ""))))
    same = "a hot passage of many words again and again"
    return [*out, *[(same, "en")] * 150, (None, "en"), ("", None), (" ., ", "de"), ("word " * 5000, "fr"), ("only here", "xx")]


@pytest.mark.parametrize(("most", "limits"), [(3, phrases.LIMITS), (3, phrases.Limits(300, 500, 200, 40)), (4, phrases.Limits(300, 700, 300, 20)), (2, phrases.Limits(50, 90, 100, 30)), (5, phrases.Limits(1000, 2000, 100, 3))])
def test_collocations_equal_plain_counting(spark, most, limits):
    rows = corpus(most)
    docs = spark.createDataFrame([(t, x, 1, "w") for t, x in rows], "text string, lang string, n long, words string").repartition(7)
    out = [tuple(r) for r in phrases.collocations(docs, most, limits=limits).collect()]
    expected = plain(rows, most)
    assert len(expected) > 100 and sorted(out) == expected


def test_top_and_ties(spark):
    rows = [(f"{a} {b}. " * 10, "en") for a in "bac" for b in ("é", "z", "d", "ζ")] + [("q r. " * 30, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for top in (1, 4, 9):
        assert sorted(tuple(r) for r in phrases.collocations(docs, top=top).collect()) == plain(rows, top=top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    a, l, r = 9_999_999_999_999_998, 9_999_999_999_999_999, 9_999_999_999_999_999
    found = spark.createDataFrame([([1, 2], a)], phrases.FOUND)
    counted = spark.createDataFrame([("en", 1, "x", l), ("en", 2, "y", r)], phrases.COUNTED)
    row = phrases.scored(found, counted).first()
    assert (row.l, row.r, row.score) == (l, r, 1_000_000 * a * a // (l * r))


def test_split_sorts_every_segment():
    rng = np.random.default_rng(1)
    for distinct in (1, 3, 1000):
        column = rng.integers(0, distinct, 4000).astype(np.uint64)
        pointers = rng.permutation(4000)
        start = np.array([0, 1, 7, 1000, 1001, 3500])
        size = np.diff(np.append(start, 4000))
        before = [sorted(pointers[a : a + n].tolist()) for a, n in zip(start, size, strict=True)]
        parts = phrases.split(pointers, start, size, column)
        expected = []
        for (a, n), own in zip(zip(start.tolist(), size.tolist(), strict=True), before, strict=True):
            assert sorted(pointers[a : a + n].tolist()) == own
            v = column[pointers[a : a + n]]
            assert (np.diff(v.astype(np.int64)) >= 0).all()
            expected += [a, *(a + 1 + np.flatnonzero(v[1:] != v[:-1])).tolist()]
        assert parts.tolist() == expected


def test_frequent_beginnings_are_routed_alone():
    w = np.array([[1, 1, 1, 2, 1], [1, 2, 1, 1, 1], [5, 1, 1, 1, 0]], np.uint64)
    frequent = np.array([1], np.uint64)
    kinds = dict(phrases._routes(list(w), frequent))
    rows = {k: sorted(zip(*(c.tolist() for c in v), strict=True)) for k, v in kinds.items()}
    assert rows == {1: [(2, 1, 1)], 2: [(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 2, 1)], 3: [(1, 1, 1), (1, 1, 5)]}


def test_query(spark, tmp_path):
    rows = corpus(9, 120)
    spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_collocations(spark, str(tmp_path))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == plain(rows)
