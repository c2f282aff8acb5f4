import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import suffix_tree


def brute(rows, depth, least, nats, d=0.5):
    """The definition, with dicts."""
    docs = [(i, zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else False, (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [x for _, held, x in docs if not held]
    c = Counter(w for x in train for w in x)
    total, v = sum(c.values()), len(c)
    need = max(2, math.ceil(least * total))
    base = lambda w: (c[w] + 0.1) / (total + 0.1 * (v + 1))
    n, whole = Counter(), Counter()
    for x in train:
        for i, w in enumerate(x):
            for k in range(1, min(depth, i) + 1):
                whole[tuple(x[i - k : i])] += 1
                n[tuple(x[i - k : i]), w] += 1
    entries = {}
    for (s, w), m in n.items():
        if m >= need:
            entries.setdefault(s, {})[w] = m
    states, g = {}, {}

    def p(s, w):
        while s and s not in states:
            s = s[1:]
        if not s:
            return base(w)
        return (entries[s][w] - d) / whole[s] * (w in entries[s]) + g[s] * p(s[1:], w) if w in entries[s] else g[s] * p(s[1:], w)

    for s in sorted(entries, key=len):
        e = entries[s]
        g[s] = max(1 - sum(m - d for m in e.values()) / whole[s], 1e-12)
        gain = sum(m * math.log(((m - d) / whole[s] + g[s] * p(s[1:], w)) / p(s[1:], w)) for w, m in e.items()) + (whole[s] - sum(e.values())) * math.log(g[s])
        if gain >= nats:
            states[s] = True
    out = []
    for i, held, x in docs:
        score = sum(math.log10(p(tuple(x[max(0, k - depth) : k]), w)) for k, w in enumerate(x))
        out.append((i, held, len(x), sum(c[w] > 0 for w in x), total, sum(math.log10(base(w)) for w in x), score))
    return out, len(states)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["the", "of", "A", "é", "Ünd"] + [f"w{k}" for k in range(60)]
    phrase = "once upon a time there was a small grey cat".split()
    out = [None, "", " \n", "THE the The"]
    for _ in range(n):
        w = [r.choice(vocab[: r.choice([5, 20, 65])]) for _ in range(r.randint(1, 60))]
        if r.random() < 0.4:
            at = r.randrange(len(w))
            w[at:at] = phrase
        out.append(" ".join(w))
    return list(enumerate(out))


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], abs_tol=1e-6) and math.isclose(a[6], b[6], abs_tol=1e-6), (a, b)


def test_equals_brute_force(spark):
    for seed, least, nats in ((1, 1e-3, 10.0), (2, 4e-6, 3.0)):
        rows = corpus(seed)
        rows += [rows[9], rows[9], (None, "the of"), (3, "once upon a dog")]
        docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
        want, states = brute(rows, 3, least, nats)
        assert states > 5
        same(suffix_tree.lm_scores(docs, 3, least, nats).collect(), want)


def test_many_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "PART", 100)
    chunks = suffix_tree.chunks_of
    monkeypatch.setattr(suffix_tree, "chunks_of", lambda rows: chunks(rows, 150))
    rows = corpus(6)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    same(suffix_tree.lm_scores(docs, 3, 2, 5.0).collect(), brute(rows, 3, 0, 5.0)[0])


def test_a_distribution_sums_to_one(spark):
    """P of all words after a context, and of an unknown one, by scoring one text for each of them."""
    rows = corpus(3)
    words = sorted({w for _, t in rows for w in (t or "").encode().lower().decode().split()})
    ids = iter(i for i in range(1000, 10**6) if zlib.crc32(str(i).encode()) % 10 == 0)  # held out: they change nothing
    for context in ("once upon a", "the of", "w1"):
        texts = [(next(ids), f"{context} {w}") for w in [*words, "unseen"]] + [(next(ids), context)]
        docs = spark.createDataFrame(rows + texts, "doc_id long, text string")
        got = {r.doc_id: r for r in suffix_tree.lm_scores(docs, 3, 2, 3.0).collect()}
        want = {r[0]: r for r in brute(rows + texts, 3, 0, 3.0)[0]}
        assert all(math.isclose(got[i].score, want[i][6], abs_tol=1e-6) for i, _ in texts)


def test_held_out_text_is_predicted_better_than_by_words_alone(spark):
    got = [r for r in suffix_tree.lm_scores(spark.createDataFrame(corpus(4, 300), "doc_id long, text string")).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(spark):
    assert suffix_tree.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = suffix_tree.lm_scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in got] == [(1, False, 1, 1, 1)]


def test_a_phrase_stays_learned_as_the_corpus_grows(spark):
    phrase = "zither quell ombre vexed knoll jumps"
    gains = []
    for n in (200, 40_000):  # of 840,000 tokens a share of 4e-6 is more than three
        r = random.Random(n)
        rows = [(i, " ".join(f"f{r.randrange(50)}" for _ in range(20))) for i in range(n)]
        train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10][:3]
        held = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0)
        rows = [(i, phrase if i in train or i == held else t) for i, t in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = suffix_tree.lm_scores(docs).where(f"doc_id = {held}").first()
        gains.append(got.score - got.base_score)
    assert gains[0] > 3 and gains[1] > gains[0]


def test_a_task_holds_few_chunks_however_few_files_the_table_has(spark, monkeypatch):
    """Answers of all chunks of a bucket meet in one task, so buckets are as many as the texts need."""
    chunks = suffix_tree.chunks_of
    monkeypatch.setattr(suffix_tree, "CHUNK", 100)
    monkeypatch.setattr(suffix_tree, "chunks_of", lambda rows: chunks(rows, 100))
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten " * 3) for i in range(1500)], "doc_id long, text string").coalesce(1)
    corpus = suffix_tree.Corpus(suffix_tree.folds(docs), 3)
    n = corpus.table().count()
    assert n > 300 and corpus.buckets >= n / suffix_tree.BUCKET > 2 * spark.sparkContext.defaultParallelism
    corpus.close()


def test_values_are_packed_across_batches(spark):
    bits = 3
    values = spark.range(0, 1000, 1, 1).selectExpr("xxhash64(id) as key", "cast(id as double) as value")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = suffix_tree.packed_values(values, bits).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 1 << bits and sum(len(r["keys"]) for r in rows) == 8000


def test_hot_contexts_of_every_length(spark, monkeypatch):
    """Contexts whose windows are too many for one part: some words, pairs and triples, in many chunks and parts."""
    monkeypatch.setattr(suffix_tree, "PART", 100)
    chunks = suffix_tree.chunks_of
    monkeypatch.setattr(suffix_tree, "chunks_of", lambda rows: chunks(rows, 150))
    rows = corpus(7) + [(None, "the of the"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 0, 3.0)[0]
    for many in (2, 20, 60):
        monkeypatch.setattr(suffix_tree, "HOT", many)
        same(suffix_tree.lm_scores(docs, 3, 2, 3.0).collect(), want)


def test_what_goes_between_tasks_is_a_few_times_the_text(spark):
    """Copies make most grams entries; their keys and answers once were ten times the text."""
    r = random.Random(8)
    texts = [" ".join(f"word{int(r.paretovariate(0.6))}"[:9] for _ in range(200)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, texts[i % 1000]) for i in range(2000)], "doc_id long, text string").repartition(4)
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    suffix_tree.lm_scores(docs).collect()
    moved, size = written() - before, 2 * sum(map(len, texts))
    assert 0 < moved < 4 * size, moved / size


def test_windows_go_in_waves(spark, monkeypatch):
    """All windows and all answers to them were on disk together once, more than four times the table."""
    monkeypatch.setattr(suffix_tree, "PART", 100)
    chunks, windows = suffix_tree.chunks_of, suffix_tree.Corpus.windows
    monkeypatch.setattr(suffix_tree, "chunks_of", lambda rows: chunks(rows, 150))
    sizes, parts = [], []

    def seen(*args):
        out = windows(*args)
        size, found = out.agg(F.sum(F.octet_length("data")), F.collect_set("part")).first()
        sizes.append(size)
        parts.append(set(found))
        return out

    monkeypatch.setattr(suffix_tree.Corpus, "windows", seen)
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for many in (suffix_tree.HOT, 20):
        monkeypatch.setattr(suffix_tree, "HOT", many)
        sizes.clear()
        parts.clear()
        same(suffix_tree.lm_scores(docs, 3, 2, 3.0).collect(), brute(rows, 3, 0, 3.0)[0])
        assert len(sizes) > 1 and max(sizes) < 0.7 * sum(sizes)
        assert sum(map(len, parts)) == len(set.union(*parts))


def test_packed_columns_come_back_and_repeats_take_little_room():
    r = np.random.default_rng(1)
    few = r.integers(-(1 << 63), 1 << 63 - 1, 8)[r.integers(0, 8, 5000)]
    columns = [np.arange(5000, dtype="<u8"), few, r.random(8)[r.integers(0, 8, 5000)], np.arange(5000, dtype="<u4")]
    kinds = ["<u8", "<i8", "<f8", "<u4"]
    sides = [suffix_tree.planes(c) for c in columns]
    for at, to in ((0, 5000), (7, 4000), (9, 9)):
        for got, want in zip(suffix_tree.unpacked(suffix_tree.packed(sides, at, to), kinds), columns):
            assert got.tolist() == want[at:to].tolist()
    assert len(suffix_tree.packed(sides, 0, 5000)) < 5000 * 5
