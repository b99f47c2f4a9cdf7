"""Each operator against a plain computation, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, jaccard_join, line_dedup, nbsvm, packing, quality_rules, token_counts, token_ids, url_filter
from tessera.llm.blocks import Texts
from tessera.llm.components import components
from tessera.llm.shared import doc_tie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "ve", "zo") for b in ("ra", "den", "Lis", "mon,", "pek.", "qui", "sól", "the", "of", "")]


def prose(rng, n, lines=True):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "".join(w + ("\n" if lines and rng.random() < 0.1 else " ") for w in words)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(n)]
    near = [edited(rng, rng.choice(base), rng.randrange(1, 6)) for _ in range(n)]
    texts = [*base, *near, *base[:5], "", " \n ", None, "one", "one two", "Ünï ☃ \u3000 wide \x1c odd", prose(rng, 30000)]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "null id here", None, None, None), (None, base[3], None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_counts(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, docs, rows):
    extra = [(900, "a b c d e f g h " * 3 + "x", "", "", 0), (901, "x ## <b>\nx ## <b>\n\nx", "", "", 0)]
    made = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    out = quality_rules.judge(made).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_keep_other_columns(spark):
    frame = spark.createDataFrame([(1, "a b", 5, "x", 2.5, "y", "z")], "doc_id long, text string, N_Words int, _w string, _H double, _tagged string, Kept string")
    row = quality_rules.judge(frame).first()
    assert (row["_w"], row["_H"], row["_tagged"], row.n_words, row.kept) == ("x", 2.5, "y", 2, False)
    assert sorted(c.lower() for c in row.asDict()) == sorted({"doc_id", "text", "_w", "_h", "_tagged", "base_failed", "kept", *quality_rules.COUNTS})


def test_quality_filter_runs_on_long_texts(docs):
    assert quality_rules.judge(docs).where("kept").count() >= 0  # the filter stays above the counts


def test_quality_rules_keep_prose_and_reject_symbols(spark):
    good = "the cat of the house and a dog in the garden is with the bird that was on to it for a walk by the sea today again"
    bad = " ".join(f"w{i}$$$ x{i}###" for i in range(30))
    out = quality_rules.judge(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in out.collect()} == {1: True, 2: False}


def test_classifier_separates_and_scores_every_row(spark, docs, rows):
    rng = random.Random(1)
    known = [(prose(rng, 60, lines=False), 1) for _ in range(150)] + [(" ".join([rng.choice(VOCABULARY).upper() + "!!"] * 40), 0) for _ in range(60)] + [("x", None), (None, 1)]
    model = nbsvm.train(spark.createDataFrame(known, "text string, label int"))
    held = [(prose(rng, 60, lines=False), 1) for _ in range(30)] + [(" ".join([rng.choice(VOCABULARY).upper() + "!!"] * 30), 0) for _ in range(30)]
    scored = nbsvm.score(spark.createDataFrame(held, "text string, label int"), model).collect()
    assert sum(r.predicted == r.label for r in scored) >= 57
    out = nbsvm.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert nbsvm.score(empty(spark), model).count() == 0
    one = nbsvm.train(spark.createDataFrame([("a b", 1)], "text string, label int"))
    assert nbsvm.score(docs.limit(1), one).first().score > 0.5
    assert nbsvm.train(spark.createDataFrame([], "text string, label int")).b == 0


def test_classifier_is_not_taken_over_by_copies(spark):
    rng = random.Random(2)
    good = [(prose(rng, 60, lines=False), 1) for _ in range(150)]
    bad = [(" ".join([rng.choice(VOCABULARY).upper() + "!!"] * 40), 0) for _ in range(150)]
    held = [(prose(rng, 60, lines=False), 1) for _ in range(30)] + [(" ".join([rng.choice(VOCABULARY).upper() + "!!"] * 30), 0) for _ in range(30)]
    for copied in (good[0], bad[0]):
        model = nbsvm.train(spark.createDataFrame([*good, *bad, *[copied] * 2000], "text string, label int"), sample_rows=200)
        out = nbsvm.score(spark.createDataFrame(held, "text string, label int"), model).collect()
        assert sum((r.score >= 0.5) == r.label for r in out) >= 57


def test_hinge_fit_reaches_the_optimum():
    rng = np.random.default_rng(4)
    r = rng.normal(size=12)
    rows = [np.flatnonzero(rng.random(12) < 0.5).astype(np.uint32) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    x = np.zeros((40, 13))
    for k, i in enumerate(rows):
        x[k, i], x[k, 12] = r[i] / np.sqrt(max(len(i), 1)), 1.0
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    w, best = np.zeros(13), np.inf
    for t in range(1, 60001):  # a plain subgradient descent
        w = w - (w - (y[:, None] * x)[y * (x @ w) < 1].sum(axis=0)) / (t + 10)
        best = min(best, loss(w)) if t % 50 == 0 else best
    assert loss(nbsvm.fit_hinge(rows, y, r, epochs=400)) <= best * 1.01


def test_class_counts_equal_a_plain_count(spark):
    rng = random.Random(6)
    known = [(prose(rng, 20, lines=False), i % 2) for i in range(30)]
    rows = spark.createDataFrame([(i, l, t) for i, (t, l) in enumerate(known)], "key long, label int, text string")
    made = rows.mapInArrow(nbsvm._feature_batches, "key long, label int, ids binary").mapInArrow(nbsvm._count_batches, "f long, pos long, neg long")
    got = {r.f: (r.pos, r.neg) for r in made.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    want = Counter()
    for text, label in known:
        for f in nbsvm.features(Texts(0, np.array([0, len(text.encode())]), np.frombuffer(text.encode(), np.uint8)))[0].tolist():
            want[f, label] += 1
    assert got == {f: (want[f, 1], want[f, 0]) for f, _ in want}


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [token_ids.END_ID]


@pytest.mark.parametrize("text", ["don't STOP 3.14", "a<|endoftext|>b <b>", "İstanbul ΣΑΣ", "e\u0301 café", "x\x1cy", "\u3000a\xa0b", "naïve—dash “q” 日本", "a\x00b", "ß ÿ × ÷ µ"])
def test_encoder_equals_library(ids, text):
    made = token_ids.encoder(token_ids.default_path()).text(text)
    assert np.frombuffer(made, "<u4").tolist() == ids(text)[:-1]


def test_packing(spark, docs, rows, ids):
    pieces = packing.pack(docs.withColumn("part", F.lit(1)), length=64).collect()
    held = Counter()
    for p in pieces:
        held[p.sequence_id] += p.length
        assert len(p.ids) == 4 * p.length and p.offset + p.length <= 64
    assert sorted(held.values())[1:] == [64] * (len(held) - 1)
    assert sum(held.values()) == sum(len(ids(r[1])) for r in rows)
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        whole.setdefault(p.doc_id, b"")
        whole[p.doc_id] += p.ids
    for i, text, *_ in rows[1:-2]:
        if i:
            assert np.frombuffer(whole[i], "<u4").tolist() == ids(text)
    made = packing.sequences(packing.pack(docs, length=64)).collect()
    assert all(len(s.ids) == 4 * s.length for s in made)
    assert packing.pack(empty(spark)).count() == 0


def test_token_files(spark, docs, rows, ids, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_ids.write_ids(docs, path, partitions=3)
    out = sorted(token_ids.index(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in out] == [r[0] for r in order]
    start = 0
    for r in out:
        assert r.start == start
        start += r.n_tokens
    by = {r.doc_id: r for r in out}
    for i, text, *_ in rows[1:-2]:
        assert by[i].n_tokens == len(ids(text)) and by[i].ids_crc32 == zlib.crc32(np.array(ids(text), "<u4").tobytes())
    assert token_ids.read_ids(spark, path).where("doc_id = 7").first().ids == ids(rows[7][1])
    token_ids.write_ids(empty(spark), f"{path}-none")
    assert token_ids.index(spark, f"{path}-none").count() == 0


def test_token_files_carry_indexes(spark, tmp_path, monkeypatch):
    import pyarrow.orc as orc

    monkeypatch.setattr(token_ids, "STRIPE_BYTES", 1 << 14)
    rng = random.Random(9)
    rows = [(2 * i, " ".join(rng.choice(VOCABULARY) for _ in range(20))) for i in range(12_000)]
    token_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids", partitions=1)
    f = orc.ORCFile(str(next((tmp_path / "ids").glob("part-*.orc"))))
    assert f.nstripes >= 2 and f.row_index_stride == token_ids.STRIDE
    assert b"doc_id" in f.read_stripe(1).schema.to_string().encode() and f.read_stripe(1).column("doc_id")[0].as_py() > f.read_stripe(0).column("doc_id")[-1].as_py()

    def read(doc_id):
        """(rows found, rows that the scan hands on)"""
        df = token_ids.read_ids(spark, f"file://{tmp_path}/ids").where(F.col("doc_id") == doc_id)
        n = len(df.collect())
        return n, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    n, seen = read(rows[7000][0])
    assert n == 1 and seen <= token_ids.STRIDE  # one row group of the twelve
    absent = [read(rows[k][0] + 1) for k in (500, 3500, 7500, 11500)]  # inside the bounds of a row group, so only its Bloom filter can tell
    assert [n for n, _ in absent] == [0] * 4 and sum(seen == 0 for _, seen in absent) >= 3


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>\n", "ends <", "|> \\", "", None, "ünï ☃\n\n", "\\<|", "<" * 5]
    turns = [(c, t, ("user", "assistant", "system", None, "<|x|>")[(t + c) % 5], said[(t * c + t) % len(said)], "extra") for c in range(6) for t in range(9)]
    turns += [(None, 0, "assistant", "no id", ""), (2, 3, "assistant", "tie", ""), (3, None, "user", "no turn", ""), (3, None, "user", "no turn", "")]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string")
    out = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(made)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: tuple((x is not None, x if x is not None else "") for x in t[1:4]))
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x, _ in own)
        loss = "".join(x or "" for _, _, r, x, _ in own if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (out[c].n_turns, out[c].loss_chars, out[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    none = spark.createDataFrame([], made.schema)
    assert chat_format.digests(chat_format.format_conversations(none)).count() == 0


def test_chat_long_conversation_in_parts(spark, monkeypatch):
    turns = spark.range(400).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word \\ "), 2000).alias("text"))
    parts = chat_format.format_conversations(turns).cache()
    assert parts.count() > 1 and parts.where("last").count() == 1
    r = chat_format.digests(parts).first()
    said = "word \\ " * 2000
    whole = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n{said}\n" for i in range(400))
    assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_chars == 200 * len(said)


def test_token_counts_equal_a_library(spark, docs, rows):
    from tokenizers import Tokenizer, models

    pieces = token_counts.load_pieces(token_counts.default_path())
    bytes_ = [(f"<0x{i:02X}>", -1e9) for i in range(256)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items(), *bytes_], 0, byte_fallback=True))
    for r in token_counts.count_tokens(docs.withColumn("n_words", F.lit("clash"))).collect():
        words = WORDS.findall(r.text or "")
        assert r.n_words == len(words)
        each = {w: len(t.encode("▁" + w).ids) for w in set(words)}
        assert r.n_tokens == sum(each[w] for w in words)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_trie_restart_changes_nothing(monkeypatch):
    pieces = {"▁": -3.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -2.0}
    one, two = token_counts.PieceTrie(pieces), token_counts.PieceTrie(pieces)
    monkeypatch.setattr(token_counts, "MAX_NODES", 2)
    texts = ["ab abb bba", "xa é ab", "", "abab " * 20]
    assert [one.count_text(t) for t in texts] == [(two.clear(), two.count_text(t))[1] for t in texts]


def test_trie_stays_bounded_within_one_text_and_word(monkeypatch):
    pieces = {"▁": -3.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -2.0}
    whole, small = token_counts.PieceTrie(pieces), token_counts.PieceTrie(pieces)
    rng = random.Random(3)
    words = ["".join(rng.choice("abx") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    want = whole.count_text(" ".join(words))
    monkeypatch.setattr(token_counts, "MAX_NODES", 100)
    monkeypatch.setattr(token_counts, "LONG_WORD", 20)
    assert small.count_text(" ".join(words)) == want and len(small.best) <= 100 + 21


def plain_set(text, n):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_classes(rows, n, num, den):
    sets = [plain_set(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0] is not None, r[0] or 0, len(sets[i]), -1 if (c := least.get(root(i)) if sets[i] else r[0]) is None else c) for i, r in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 7, 10)])
def test_jaccard_join_equals_all_pairs(docs, rows, n, num, den):
    out = jaccard_join.classes(docs.withColumn("n", F.lit("clash")), jaccard_join.Likeness(n, num, den)).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == plain_classes(rows, n, num, den)


def test_buckets_looked_at_in_parts_find_the_same(spark, docs, monkeypatch):
    like = jaccard_join.Likeness(3, 8, 10)
    plans = {b: jaccard_join.plan_band(b, like, 100) for b in range(1, 16)}
    index = jaccard_join.keys_table(docs, like, plans, 2)
    whole = sorted(map(tuple, jaccard_join.met_sets(index).collect()))
    monkeypatch.setattr(jaccard_join, "PART", 40)
    assert whole and sorted(map(tuple, jaccard_join.met_sets(index).collect())) == whole


def test_jaccard_join_empty(spark):
    assert jaccard_join.classes(empty(spark), jaccard_join.Likeness(3, 9, 10)).count() == 0


@pytest.mark.parametrize("deletions", [False, True])
def test_keys_meet_for_every_near_pair(deletions):
    rng = np.random.default_rng(5)
    like = jaccard_join.Likeness(1, 8, 10)
    for _ in range(300):
        size = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        x = len(np.intersect1d(a, b))
        if not len(b) or 10 * x < 8 * (len(a) + len(b) - x):
            continue
        big = max(len(a), len(b))
        band = jaccard_join.bands_of(big, like)[0]
        assert band in jaccard_join.bands_of(len(a), like) and band in jaccard_join.bands_of(len(b), like)
        apart = like.most_apart(2 * (jaccard_join.EDGES[band + 1] - 1))
        plan = jaccard_join.Plan(apart // 2 + 1, 0, True) if deletions else jaccard_join.Plan(apart + 3, 2, False)
        assert len(np.intersect1d(jaccard_join.cell_keys(a, band, plan), jaccard_join.cell_keys(b, band, plan)))


def test_keep_one(spark, docs, rows):
    kept = jaccard_join.keep_one(docs, jaccard_join.Likeness(5, 8, 10))
    assert kept.columns == docs.columns
    named = {r.doc_id for r in kept.collect()}
    want = {d for has, d, _, c in plain_classes(rows, 5, 8, 10) if has and d == c}
    assert named - {None} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_line_dedup(rows, tie=lambda i, text: text):
    """The new text of each distinct (has id, id, text); rows of one id are ordered by tie."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda o: (o[0], o[1], tie(o[1] if o[0] else None, o[2])))
    by_token, out = {}, {}
    for has, i, text in order:
        keep = []
        for line in text.split("\n"):
            s = plain_set(line, 1)
            near = {o for t in s for o in by_token.get(t, ())}
            if not any(10 * len(s & o) >= 8 * len(s | o) for o in near):
                keep.append(line)
            for t in s:
                by_token.setdefault(t, set()).add(s)
        out[has, i, text] = "\n".join(keep)
    return out


def spark_tie(spark, rows):
    """The hash that orders rows of one doc_id."""
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    ties = {(r.doc_id, r.text): r.tie for r in frame.select("doc_id", "text", doc_tie(F.col("doc_id"), F.col("text")).alias("tie")).collect()}
    return lambda i, text: ties[i, text]


def near_lines(rng, n):
    """A group of near copies of one line, and lines of few words."""
    base = [rng.choice(VOCABULARY) + str(i) for i in range(20)]
    copies = [" ".join(rng.choice(VOCABULARY) if rng.random() < 0.08 else w for w in base) for _ in range(n)]
    return [c + "\n" + " ".join(rng.choice(VOCABULARY[:12]) for _ in range(3)) for c in copies]


@pytest.mark.parametrize("limits", [line_dedup.LIMITS, line_dedup.Limits(seen=5, postings=200, bucket=300, hot=60, quota=1, few=1, large=4, neighbours=2), line_dedup.Limits(quota=2, few=1, large=8, neighbours=1, pairs=20)])
def test_line_dedup_equals_all_pairs(spark, limits):
    rng = random.Random(8)
    rows = [*corpus(seed=8, n=30)]
    base = prose(rng, 40)
    rows += [(None, edited(rng, base, 2), "", "", 0), (None, edited(rng, base, 3), "", "", 0), (5, edited(rng, base, 1), "", "", 0), (-(1 << 63), edited(rng, base, 1), "", "", 0), (700, base, "", "", 0), (700, base, "", "", 0)]
    rows += [(800 + i, t, "", "", 0) for i, t in enumerate(near_lines(rng, 120))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("_gone", F.lit("clash")).withColumn("tie", F.lit(1)).withColumn("_doc", F.lit(2))
    out = line_dedup.dedup_lines(frame.withColumn("n_lines_removed", F.lit("clash")).withColumn("old", F.col("text")), limits=limits).collect()
    assert set(out[0].asDict()) == {*frame.columns, "old", "n_lines_removed"} and out[0]["_gone"] == "clash"
    want = plain_line_dedup(rows, spark_tie(spark, rows))
    assert len(out) == len(rows)
    for r in out:
        assert r.text == (None if r.old is None else want[r.doc_id is not None, r.doc_id or 0, r.old])
        assert (r.n_lines_removed == 0) == (r.text == r.old)


@pytest.mark.parametrize("pairs", [60, 400_000])
def test_line_dedup_looks_past_many_near_misses(spark, pairs):
    """Groups of 120 lines just below the bound, one above it, and the line that all are made from last: only that goes, whatever is looked at together."""
    rng, rows = random.Random(7), []
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(41)]
        made = lambda n, i, base=base, g=g: " ".join([*rng.sample(base, 41 - n), *(f"g{g}l{i}x{k}" for k in range(n))])
        lines = [made(5, i) for i in range(120)]
        lines.insert(rng.randrange(120), made(4, 120))
        rows += [(1000 * g + i, t) for i, t in enumerate([*lines, " ".join(base)])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limits=line_dedup.Limits(quota=4, few=2, large=1000, pairs=pairs))
    assert sorted(r.doc_id for r in out.where("n_lines_removed > 0").collect()) == [1000 * g + 121 for g in range(10)]


def test_line_dedup_a_sure_candidate_does_not_close_a_line():
    """A line whose nearest candidate is not sure, but another is, is compared no further in a large group: it stays open."""
    def row(token, n, i, s0, doc):
        return token, doc, 0, 0, n, i, s0
    sketch = lambda bits: (1 << bits) - 1
    rows = [row(9, 50, 0, sketch(6), 1), row(9, 32, 0, sketch(5), 2), row(9, 50, 0, sketch(1), 0), row(9, 40, 0, 0, 3)]
    rows += [row(9, 400 + k, 0, 0, 10 + k) for k in range(80)]
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint64)
    columns = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] + [np.zeros(len(rows), np.uint64)] * 3
    b = line_dedup._Bucket(columns, line_dedup.LIKE, line_dedup.Limits(neighbours=2))
    met = list(b.candidates(None))
    at = int(np.flatnonzero(b.doc == 3)[0])
    best = line_dedup._best([m for m in met if len(m[0])], b)
    named = set(b.doc[best[1][best[0] == at]].tolist())
    assert named and (0 in named or b.unseen[at])


def test_line_dedup_hot_words_meet_by_band(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["the", *(rng.choice(VOCABULARY[:14]) + str(rng.randrange(2)) for _ in range(rng.randrange(1, 40)))]), "", "", 0) for i in range(250)]
    want = plain_line_dedup(rows, spark_tie(spark, rows))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), limits=line_dedup.Limits(hot=20, bucket=200)).collect()
    assert {r.doc_id: r.text for r in out} == {k[1]: t for k, t in want.items()} and sum(r.n_lines_removed for r in out) > 3


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_null_id_holds_the_first_line(spark):
    words = [f"w{i}" for i in range(12)]
    near = lambda i: " ".join([*words[:i], f"x{i}", *words[i + 1 :]])
    rows = [(None, "only here\n" + " ".join(words)), (None, "apart from all others"), (1, " ".join(words)), (2, near(3) + "\nstays as it is"), (3, near(7)), (4, "a line of its own")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc_id, r.text) for r in out.collect()} == {*rows[:2], (1, ""), (2, "stays as it is"), (3, ""), rows[5]}


def plain_leaks(text, item, rate=decontaminate.RATE):
    low = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, b = low(text), low(item)
    k, best = int(len(b) * rate), None
    if not b:
        return None
    for s in range(len(w)):
        window = w[s : s + len(b)]
        row = list(range(len(window) + 1))
        for i, x in enumerate(b, 1):
            new = [i]
            for j, y in enumerate(window, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        if row[-1] <= k and (best is None or row[-1] < best[2]):
            best = (s, len(window), row[-1])
    return best


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(11)
    items = [prose(rng, rng.randrange(6, 40)).upper() for _ in range(12)] + ["zzz yyy xxx www", "vvv", None, ""]
    texts = [prose(rng, 60) for _ in range(10)]
    for item in items[:12]:
        for edits in (0, 1, 2, 4):
            texts.append(prose(rng, rng.randrange(0, 30)) + edited(rng, item, edits) + " " + prose(rng, rng.randrange(0, 20)))
    texts += ["", None, items[0], items[0], "a ZZZ yyy xxx www b", "zzz yyy www", "a\nvvv", prose(rng, 20000) + items[3] + " " + prose(rng, 3000), " ".join(items[4].split()[:-1])]
    rows = [*enumerate(texts), (None, items[1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (None, items[2])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.distance) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(i, j): x for i, t in rows for j, b in [*enumerate(items), (None, items[2])] if (x := plain_leaks(t, b))}
    missed = set(want) - set(got)
    assert not set(got) - set(want) and len(missed) <= 0.01 * len(want)
    assert all(want[k][2] > 0 for k in missed)
    assert all(got[k][2] == want[k][2] for k in got if want[k][2] == 0)
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {k[0] for k in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.keep_clean(docs, none).count() == len(rows)
    assert decontaminate.leaks(empty(spark), bench).count() == 0


def test_edit_distance_equals_a_plain_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        masks = {x: sum(1 << i for i, y in enumerate(a) if x == y) for x in a}
        assert decontaminate.distance(masks, len(a), b) == row[-1]


def altered(rng, item, k, how):
    """item with k edits: words replaced at the head, at the tail, in one place, evenly or at random; or words put in, taken out, or cut off the head."""
    m, new = len(item), lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    out = item.copy()
    if how in ("put in", "taken out", "cut off"):  # each shifts the rest, so the window loses or gains as many words at its end
        k //= 2
        if how == "put in":
            return np.insert(out, np.sort(rng.integers(1, m, k)), new(k))
        return np.delete(out, rng.permutation(m)[:k] if how == "taken out" else np.arange(k))
    at = {"head": np.arange(k), "tail": np.arange(m - k, m), "one place": np.arange(k) + rng.integers(0, m - k + 1), "even": (np.arange(1, k + 1) * (m + 1)) // (k + 1) - 1, "random": rng.permutation(m)[:k]}[how]
    out[at] = new(k)
    return out


@pytest.mark.parametrize("m", [5, 6, 8, 10, 15, 25, 40, 60, 100])
@pytest.mark.parametrize("how", ["head", "tail", "one place", "even", "random", "put in", "taken out", "cut off"])
def test_decontamination_recall_at_the_largest_distance(m, how):
    rng = np.random.default_rng(m)
    found, trials = 0, 60
    k = int(m * decontaminate.RATE + 1e-9)
    for trial in range(trials):
        items = decontaminate.Items.of([(0, " ".join(f"w{i}-{trial}" for i in range(m)))], decontaminate.RATE)
        lead = rng.integers(0, 30)
        h = np.concatenate([rng.integers(1, 1 << 62, lead).astype(np.uint64), altered(rng, items.items[0].words, k, how), rng.integers(1, 1 << 62, 30).astype(np.uint64)])
        w = decontaminate.Words(np.arange(len(h)), np.arange(len(h)), h, np.array([0, len(h)]))
        found += bool(decontaminate.find(w, items))
    assert found >= 0.9 * trials


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[:0:-1] if fits else (None, None)))


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1?q=1", "https://x.net/a", "https://x.net", "https://notnet/a", "https://example.com/de/x#t", "https://wexample.com/de/", "http://b.org/fr/", "http://b.org/fr", None, "", "nothing", "a://b://c.net/d", "http://é.net/ü\nx", "http://x.net?/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string").withColumn("_bad", F.lit(7)).withColumn("tokens", F.lit(8)).withColumn("_fixed", F.lit(9))
    known = spark.createDataFrame([(f"http://spam{i}.biz/win/{i}", True) for i in range(40)] + [(f"http://good.org/en/{i}", False) for i in range(200)] + [("http://x.biz/", None)], "url string, bad boolean")
    more = pages.unionByName(spark.createDataFrame([(100, "http://other.biz/win/9", "", 7, 8, 9), (101, "http://other.info/en/9", "", 7, 8, 9)], pages.schema))
    out = {r.page_id: r for r in url_filter.judge(more, known).collect()}
    assert {(r["_bad"], r.tokens, r["_fixed"]) for r in out.values()} == {(7, 8, 9)}
    for i, u in enumerate([*urls, urls[0]]):
        host, path, rule, verdict = plain_rule(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (verdict or "allow")
    assert out[100].verdict == "block" and out[101].verdict == "allow"
    none = known.limit(0)
    assert {r.verdict for r in url_filter.judge(more.where("page_id >= 100"), none).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), known).count() == 0


def plain_mined(known):
    """The antecedents, at most one token of the host beside others, that hold in enough bad urls with enough confidence."""
    from itertools import combinations

    bads, n_of = sum(b for _, b in known), {}
    for tokens, bad in known:
        of_host = [t for t in tokens if t.startswith(("host=", "label="))]
        rest = [t for t in tokens if t not in of_host]
        for k in range(len(rest) + 1):
            for some in combinations(rest, k):
                for h in [[], *[[x] for x in of_host]]:
                    if some or h:
                        at = n_of.setdefault(tuple(sorted([*some, *h])), [0, 0])
                        at[0] += 1
                        at[1] += bad
    base, z, out = bads / len(known), url_filter.Z, set()
    for s, (n, b) in n_of.items():
        p = b / n
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if b >= url_filter.MIN_BAD and p >= base + url_filter.MIN_GAIN * (1 - base) and low > base:
            out.add(s)
    return out


def test_mined_url_rules_equal_plain_counting(spark):
    rng = random.Random(21)
    known = []
    for _ in range(900):
        host, segs = rng.choice(("spam-win", "casino", "news", "shop", "a.b")) + rng.choice((".biz", ".org", ".x.com")), [rng.choice(("in", "out", "win", "7")) for _ in range(rng.randrange(0, 3))]
        bad = rng.random() < (0.9 if "casino" in host and "win" in segs or host == "spam-win.biz" else 0.15)
        known.append((f"http://{host}/" + "/".join(segs) + rng.choice(("", "?id=3", "?q=1&id=2")), bad))
    labelled = spark.createDataFrame([*known, (known[0][0], None)], "url string, bad boolean")
    tokens = url_filter.tokens_of(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    rows = labelled.withColumn("tokens", tokens)
    want = plain_mined([(tuple(r.tokens), r.bad) for r in rows.where("bad IS NOT NULL").collect()])
    assert {tuple(r.antecedent) for r in url_filter.mine(rows).collect()} == want and len(want) > 3
    pages = spark.createDataFrame([(u,) for u, _ in known], "url string")
    judged = url_filter.judge(pages, labelled, rules=(("allow", "nowhere.test", "/"),)).withColumn("t", tokens).collect()
    assert all((r.verdict == "block") == any(set(s) <= set(r.t) for s in want) for r in judged)


def test_url_rules_of_rare_bad_urls(spark):
    known = [(f"http://site{i % 300}.org/en/{i}", i % 7 < 2) for i in range(3000)]
    known += [(f"http://www.spam.biz/a/{i}", True) for i in range(10)] + [(f"http://casino-x{i}.site{i}.info/{i}", True) for i in range(10)]
    known += [(f"http://mixed.org/in/{i}", True) for i in range(8)] + [(f"http://mixed.org/out/{i}", False) for i in range(80)]
    known += [(f"http://chance.org/{i}", i < 5) for i in range(8)] + [(f"http://few.net/{i}", True) for i in range(4)]
    urls = {"http://m.spam.biz/b": "block", "http://casino-win.new.com/": "block", "http://casino.new.com/": "block", "http://mixed.org/in/x": "block", "http://mixed.org/out/x": "allow", "http://chance.org/1": "allow", "http://few.net/1": "allow", "http://site10.org/en/1": "allow"}
    labelled = spark.createDataFrame(known, "url string, bad boolean")
    out = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), labelled, rules=(("allow", "nowhere.test", "/"),))
    assert {r.url: r.verdict for r in out.collect()} == urls
