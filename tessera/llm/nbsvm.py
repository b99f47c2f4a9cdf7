"""Quality classifier: a linear support vector machine over Naive Bayes log-count ratios.

Features are indicators of word unigrams and bigrams and of one- to three-grams of word shapes (case, digits,
last character, length class, "same as the word before"), hashed to DIMENSIONS. Class counts of each feature come from all
training rows. The machine (hinge loss, L2, dual coordinate descent) is fitted on at most SAMPLE_ROWS and about SAMPLE_BYTES of
their distinct texts, on indicators scaled by the log-count ratios and by 1/sqrt(number of features); held-out margins of two
halves fix the sigmoid that makes scores. Copies of a text count in the ratios and are one text of the sample, in one half.

Defined results: null, empty and blank texts have no feature and get the score of the bias; repeated rows are
scored one by one and each counts in training; rows with a null label are not trained on; without rows of both classes every score is the
share of label 1 (0.5 without rows). Other columns pass through; one named score or predicted is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.blocks import Texts, Words, blocks, mix, words
from tessera.llm.shared import written

BITS = 18
DIMENSIONS = 1 << BITS
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 256 << 20  # of feature ids, about
THRESHOLD = 0.3
_U = np.uint64


def _shapes(t: Texts, w: Words) -> np.ndarray:
    """A small code for the shape of each word."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.uint64)
    d = t.data
    nxt = np.append(d[1:], 0)
    upper = ((d >= 65) & (d <= 90)) | ((d == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
    letter = upper | ((d >= 97) & (d <= 122)) | (d >= 0xC4) | ((d == 0xC3) & (nxt > 0x9E))
    digit = (d >= 48) & (d <= 57)
    count = lambda m: (c := np.concatenate([[0], np.cumsum(m)]))[w.ends] - c[w.starts]
    u, a, g = count(upper), count(letter), count(digit)
    size = w.ends - w.starts
    last = d[w.ends - 1]
    tail = np.where((last >= 0x80) | ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)), 0, last)
    same = np.zeros(n, bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][np.diff(w.first) > 0]] = False
    code = tail.astype(np.int64) * 4096 + np.minimum(size, 15) // 3 * 64 + ((u == a) & (a > 1)) * 32 + upper[w.starts] * 16 + (g > 0) * 8 + (a == 0) * 4 + same * 2
    return mix(code.astype(np.uint64) + _U(0x51ED27))


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, and their offsets."""
    w = words(t)
    shape = _shapes(t, w)
    off, out = [0], []
    follow = lambda h, prev, k: mix(h[k:] * _U(0x2545F4914F6CDD1D) + prev[:-1])
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        h, s = w.hashes[a:b], shape[a:b]
        parts = [h, s]
        if len(h) > 1:
            s2 = follow(s, s, 1)
            parts += [follow(h, h, 1), s2]
            if len(h) > 2:
                parts.append(follow(s[1:], s2, 1))
        ids = np.unique((np.concatenate(parts) >> _U(64 - BITS)).astype(np.uint32))
        out.append(ids)
        off.append(off[-1] + len(ids))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.array(off)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for min |w|^2 / 2 + c sum max(0, 1 - y w.x); the last weight is the bias."""
    w, alpha = np.zeros(len(r) + 1), np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(seed))
    xs = [np.append(r[i] / np.sqrt(max(len(i), 1)), 1.0) for i in rows]
    at = [np.append(i, len(r)).astype(np.int64) for i in rows]
    norm = [float(x @ x) for x in xs]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slope = y[k] * float(w[at[k]] @ xs[k]) - 1
            new = min(max(alpha[k] - slope / norm[k], 0.0), c)
            if new != alpha[k]:
                w[at[k]] += (new - alpha[k]) * y[k] * xs[k]
                alpha[k] = new
    return w


def _sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Newton fit of p = 1 / (1 + exp(-(a m + b))), with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + np.eye(2) * 1e-6
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


@dataclass
class Model:
    weights: np.ndarray  # of each feature, ratio included
    bias: float
    a: float
    b: float

    def score(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.diff(off)
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        margin = (total[off[1:]] - total[off[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos, neg = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for label, ids in zip(batch.column("label").to_pylist(), batch.column("ids"), strict=True):
            (pos if label else neg)[np.frombuffer(ids.as_buffer(), np.uint32)] += 1
    seen = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pos[seen]), pa.array(neg[seen])], ["f", "pos", "neg"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            ids, off = features(block)
            raw = [ids[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(block.first, len(block)), batch.column("label").slice(block.first, len(block)), pa.array(raw, pa.binary())], ["key", "label", "ids"])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled (text, label 0/1). Counts use every row; the machine at most sample_rows distinct texts, chosen by their hash."""
    rows = labelled.where("label IS NOT NULL").select(F.xxhash64("text").alias("key"), F.col("label").cast("int").alias("label"), "text")
    rows = written(rows.mapInArrow(_feature_batches, "key long, label int, ids binary"), "nbsvm-features")
    counts = rows.mapInArrow(_count_batches, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    total = rows.groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        p = n1 / (n1 + n0) if n1 + n0 else 0.5
        return Model(np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    pos, neg = np.ones(DIMENSIONS), np.ones(DIMENSIONS)
    pos[counts["f"]] += counts["pos"]
    neg[counts["f"]] += counts["neg"]
    r = np.log(pos / (n1 + 2)) - np.log(neg / (n0 + 2))
    texts, size = rows.select("key", "label", F.octet_length("ids").alias("size")).distinct().agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, 1.2 * sample_rows / texts, SAMPLE_BYTES / max(size, 1))
    drawn = rows.where(F.pmod("key", F.lit(1 << 62)) < int(share * (1 << 62))).groupBy("key", "label").agg(F.first("ids").alias("ids"))
    sample = drawn.orderBy("key", "label").limit(sample_rows).toPandas()
    ids = [np.frombuffer(b, np.uint32) for b in sample["ids"]]
    y = np.where(sample["label"] == 1, 1.0, -1.0)
    half = (mix(sample["key"].to_numpy(np.int64).view(np.uint64)) & _U(1)).astype(np.int64)
    margin = np.zeros(len(ids))
    for side in (0, 1):
        w = fit_hinge([ids[k] for k in np.flatnonzero(half != side)], y[half != side], r)
        for k in np.flatnonzero(half == side):
            margin[k] = (w[ids[k]] * r[ids[k]]).sum() / np.sqrt(max(len(ids[k]), 1)) + w[-1]
    a, b = _sigmoid(margin, y)
    w = fit_hinge(ids, y, r)
    return Model(w[:-1] * r, float(w[-1]), a, b)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted. One pass without a shuffle; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            made = [shared.value.score(*features(block)) for block in blocks(batch.column(text))]
            values = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(run, schema)
