import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import log_bilinear, order_minhash, packing, text, toxicity
from linkloom.llm.components import components

DOCS = "doc_id long, text string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], DOCS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é\n-🙂", max_size=20), min_size=1, max_size=6))
def test_words_against_the_pattern(texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    data, offsets = text.utf8(pa.array([*texts, None]))
    w = text.Words(data, offsets)
    want = [pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in texts] + [[]]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for y in want for x in y]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))
    for size in (3, 10_000):
        assert [b for _, b in text.slices(offsets, size)][-1] == len(texts) + 1


def test_words_in_blocks(monkeypatch):
    data, offsets = text.utf8(pa.array(["some words " * 50, "x" * 500, "more"]))
    whole = text.Words(data, offsets).hash
    monkeypatch.setattr(text, "SLICE_BYTES", 16)
    assert (text.Words(data, offsets).hash == whole).all()


def toxic_corpus(n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [f"w{x}" for x in rng.integers(0, 300, 60)] + (["idiot", "scum"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, _, bad in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, bad) for i, _, bad in labels if got[i].held_out]
    assert sum(p == b for p, b in held) / len(held) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())


def test_toxicity_never_sees_held_out_labels(spark):
    rows, labels = toxic_corpus(150)
    docs = frame(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.bias == b.bias and (a.of_share == b.of_share).all()


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, ""), (1, ""), (None, None), (2, "x " * 20_000)])
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_model_counts(spark):
    rows = [(i, t) for i, t in enumerate(["The cat the CAT", "", None, "É é x", "the  dog\x0bthe"] * 6)] + [(100, "unseen words")]
    got = {r.doc_id: r for r in log_bilinear.score(frame(spark, rows)).collect()}
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for i, t in rows}
    c = Counter(x for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.score < 0
    assert log_bilinear.score(frame(spark, rows).limit(0)).count() == 0


def test_language_model_with_rare_tokens(spark, monkeypatch):
    rows = [(i, f"a b w{i} w{i % 9} " * 3) for i in range(60)]
    whole = {r.doc_id: (r.n_known, r.base_score) for r in log_bilinear.score(frame(spark, rows)).collect()}
    keep = log_bilinear.frequent
    monkeypatch.setattr(log_bilinear, "frequent", lambda counts: keep(counts, 8))
    few = {r.doc_id: (r.n_known, r.base_score) for r in log_bilinear.score(frame(spark, rows)).collect()}
    assert all(whole[i][0] == few[i][0] and abs(whole[i][1] - few[i][1]) < 1e-9 for i in whole)


def cyclic(n=4000, words=6):
    rng = np.random.default_rng(0)
    w = np.cumsum(rng.integers(1, 3, n)) % words  # the next word is one or two further
    return [" ".join(f"w{x}" for x in part) for part in np.array_split(w, 40)]


def test_log_bilinear_learns_and_is_normalised():
    rng = np.random.default_rng(0)
    w = np.cumsum(rng.integers(1, 3, 4000)) % 6
    of_word, count = np.array([0, 1, 2, 2, 3, 3]), np.bincount(w, minlength=6)
    m = log_bilinear.LogBilinear(of_word, count.astype(float), 1.0)
    cls = of_word[w]
    a, b = cls[1:-1], cls[:-2]
    triples, pairs = np.zeros((m.n + 1, m.n + 1, m.n), np.float32), np.zeros((m.n + 1, 6), np.float32)
    np.add.at(triples, (b, a, cls[2:]), 1)
    np.add.at(pairs, (a, w[2:]), 1)
    m.fit_classes(triples, 60)
    m.fit_words(lambda i, j: pairs[:, i:j], 60)
    got = m.log_prob(a, b, cls[2:], w[2:])
    assert got.mean() > np.log(count[w[2:]] / 4000).mean() + 0.5
    every = np.append(np.arange(6), 99)  # the last class has no tokens with vectors
    total = np.exp(m.log_prob(np.full(7, 3), np.full(7, 1), np.append(of_word, m.n - 1), every)).sum()
    assert abs(total - 1) < 1e-5


def test_language_model_scores_do_not_depend_on_partitions(spark):
    rows = [(i, t) for i, t in enumerate(cyclic() + ["", None, "rare words here"])]
    got = [{r.doc_id: (r.score, r.base_score) for r in log_bilinear.score(frame(spark, rows).repartition(n)).collect()} for n in (1, 8, 64)]
    for other in got[1:]:
        assert all(abs(x - y) < 1e-6 for i in got[0] for x, y in zip(got[0][i], other[i]))
    held = [i for i, _ in rows[:40] if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[0][i][0] for i in held) > 0.7 * sum(got[0][i][1] for i in held)


def test_language_model_against_a_plain_scorer(spark, monkeypatch):
    texts = cyclic(800, 9) + ["x y z z", "", "once"]
    df = frame(spark, list(enumerate(texts)))
    kept = []
    train = log_bilinear.train
    monkeypatch.setattr(log_bilinear, "WORDS", 8)
    monkeypatch.setattr(log_bilinear, "train", lambda *args: kept.append((args, train(*args))) or kept[-1][1])
    got = {r.doc_id: r.score for r in log_bilinear.score(df).collect()}
    (_, lexicon, _, total, distinct), m = kept[0]
    counts = Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*t.split(), None])
    name = {x: int(log_bilinear.tokens(next(text.words_of(pa.array([x or ""]), text.NOT_SPACE))[2])[0][0 if x else -1]) for x in counts}
    ids = {x: int(lexicon.of(np.array([h], np.uint64))[0]) for x, h in name.items()}
    rest = total - sum(c for x, c in counts.items() if ids[x] < lexicon.n) + distinct - lexicon.n + 1
    soft = lambda s: s - np.log(np.exp(s - s.max()).sum()) - s.max()
    for i, t in enumerate(texts):
        seq, a, b, want = [*t.split(), None], m.n, m.n, 0.0
        for x in seq:
            w = ids.get(x, lexicon.n)
            c = int(m.of_word[w]) if w < lexicon.n else m.n - 1
            want += soft((m.k[0] * m.r[a] + m.k[1] * m.r[b]) @ m.q.T + m.bias)[c] / math.log(10)
            if w < lexicon.n:
                own = np.flatnonzero(m.of_word == c)
                want += soft(m.v[own] @ m.t[a] + m.share[own])[list(own).index(w)] / math.log(10)
            else:
                want += math.log10((counts[x] + 1) / rest)
            a, b = c, a
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


def test_language_model_counts_every_position(spark):
    seen = []
    tallied = log_bilinear.tallied

    def spy(learn, keys):
        out = tallied(learn, keys)
        seen.append(out.agg(F.sum("c")).first()[0])
        return out

    rows = [(i, t) for i, t in enumerate(cyclic(500))]
    log_bilinear.tallied = spy
    try:
        total = log_bilinear.score(frame(spark, rows)).first().train_tokens
    finally:
        log_bilinear.tallied = tallied
    assert seen == [total, 2 * total]  # every token is known, so each position gives a triple and a pair


def test_language_model_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "é 🙂 " * 30_000), (3, "")]
    df = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("token", F.lit(1))
    got = log_bilinear.score(df).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 60_001] and all(math.isfinite(r.score) and r.score < 0 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=40))
def test_packing_is_valid(lengths):
    where = packing.pack(lengths, (16, 32, 64))
    bins = {}
    for n, (b, size, at) in zip(lengths, where):
        bins.setdefault((b, size), []).append((at, n))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size and size == min(s for s in (16, 32, 64) if s >= end)


def test_packing_close_to_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(1, 900, 300))] + [(900, None), (901, ""), (902, "w " * 5000), (902, "w " * 5000), (None, "a b")]
    got = packing.pack_documents(frame(spark, rows)).collect()
    assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t in rows) and sum(r.doc_id == 902 for r in got) == 6
    bins = {r.bin_id: r.bin_size for r in got}
    assert sum(r.n_words for r in got) / sum(bins.values()) > 0.95
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 6), (9, 9), (10, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == 1 for n in (1, 2, 3, 4, 5, 10)) and got[6] == got[7] == 6 and {got[n] for n in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_distance_against_the_whole_table(a, b, most):
    want = min(plain_distance(a, b), most + 1)
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    assert order_minhash.distance(x, y, most) == want
    if 0 < len(a) <= len(b) and len(b) - len(a) <= most:
        assert min(order_minhash._by_waves(x, y, most), most + 1) == want == min(order_minhash._by_bits(x, y, most), most + 1)


def edit_classes(rows, similar=0.8):
    """Classes by the edit similarity of words, over all pairs."""
    seqs = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for i, t in rows}
    root = {i: i for i in seqs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in seqs:
        for j in seqs:
            longest = max(len(seqs[i]), len(seqs[j]))
            if i < j and seqs[i] and seqs[j] and abs(len(seqs[i]) - len(seqs[j])) <= 0.2 * longest and 1 - plain_distance(seqs[i], seqs[j]) / longest >= similar - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in seqs}


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 4000, 120)]
    rows = []
    for i in range(40):  # copies of one text with more and more words changed
        w = list(base)
        for j in rng.choice(120, i // 8, replace=False):
            w[j] = f"n{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 80)) + " " + " ".join(base[:40])) for i in range(15)]
    rows += [(200, "a b"), (201, "A, b!"), (202, "a b c"), (203, ""), (204, None), (205, "a a a a a a a a a"), (206, "a a a a a a a a a a")]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(frame(spark, rows)).collect()}
    assert got == edit_classes(rows)


def test_recall_of_planted_edits(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for rate in range(1, 11):
        for i in range(60):
            n = int(rng.integers(60, 400))
            w = [f"w{x}" for x in rng.integers(0, 3000, n)]
            v = []
            for x in w:  # a word changed, left out, or one put in
                kind = rng.integers(0, 3) if rng.random() < rate / 100 else 3
                v += {0: [f"n{rng.integers(0, 10**9)}"], 1: [], 2: [x, f"n{rng.integers(0, 10**9)}"], 3: [x]}[int(kind)]
            a = len(rows)
            rows += [(a, " ".join(w)), (a + 1, " ".join(v))]
            pairs.append((rate, a, a + 1))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(frame(spark, rows)).collect()}
    for rate in range(1, 11):
        found = [got[a] == got[b] for r, a, b in pairs if r == rate]
        assert sum(found) / len(found) >= 0.9, rate
    assert len({got[a] for _, a, _ in pairs}) == len(pairs)


def test_near_duplicates_edges(spark):
    df = frame(spark, [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (7, "ONE two, three four five six")])
    got = sorted(((r.doc_id, r.class_id) for r in order_minhash.classes(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (None, None)]
    kept = order_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [5, 5, None]
    assert order_minhash.classes(df.limit(0)).count() == 0


def test_alignment_needs_the_order():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.similarity(a, a) == 1.0
    assert order_minhash.similarity(a, np.concatenate((a[50:], a[:50]))) == 0.0
    b = a.copy()
    b[10:20] += np.uint32(1000)
    assert order_minhash.similarity(a, b) == 0.9


def test_near_duplicates_of_long_texts_and_clashing_names(spark, monkeypatch):
    rng = np.random.default_rng(8)
    w = [f"w{x}" for x in rng.integers(0, 5000, 40_000)]
    v = list(w)
    for j in rng.choice(len(w), 900, replace=False):
        v[j] = "other"
    rows = [(1, " ".join(w), 7, "k"), (2, " ".join(v), 8, "k"), (3, None, 9, "k"), (4, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int, key string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = order_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.class_id) for r in kept.collect()) == [(1, 7), (3, 9), (4, None)]


def test_components_of_a_star(spark):
    links = spark.range(1, 5000).selectExpr("id AS a", "0L AS b").unionAll(spark.range(5000, 5600).selectExpr("id AS a", "id + 1 AS b"))
    got = components(links).groupBy("root").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5000), (5000, 601)]


def test_few_links_take_few_jobs(spark):
    links = spark.range(200).selectExpr("id * 7 % 200 AS a", "(id * 7 + 7) % 200 % 90 AS b")
    spark.sparkContext.setJobGroup("few links", "")
    got = sorted(map(tuple, components(links).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setJobGroup("other", "")
    assert 0 < jobs <= 8
    assert got == sorted(map(tuple, components(links, at_once=0).collect()))
