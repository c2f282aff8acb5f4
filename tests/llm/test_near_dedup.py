import random

from millrace.llm import near_dedup

BLANK = "\t\n\x0b\x0c\r "


def words_of(text):
    out, at = [], ""
    for c in text or "":
        if c in BLANK:
            out += [at] if at else []
            at = ""
        else:
            at += c.lower() if c.isascii() else c
    return out + ([at] if at else [])


def shingles(text, k=4):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows):
    ids = {d for d, _ in rows if d is not None}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None and shingles(t)]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(d, len(shingles(t)), find(d), find(d) == d) for d, t in rows if d is not None}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    texts = [None, "", " \t", "One two", "one  TWO", "é é é é é", "É é é é é", "a\xa0b c d e"]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(5, 160))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            base = w if r.random() < 0.5 else base  # chains
            texts.append(" ".join(w))
    shared = " ".join(r.choice(vocab) for _ in range(30))
    texts += [shared + " " + " ".join(r.choice(vocab) for _ in range(25)) for _ in range(30)]
    texts += ["the same text in many a row of the table"] * 60
    r.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for seed in (1,):
        rows = corpus(seed)
        rows += [rows[5], rows[5], (None, "x y z"), (None, None)]
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
        got = near_dedup.groups_of(docs).collect()
        assert {tuple(r) for r in got if r.doc_id is not None} == brute(rows)
        assert len(got) == len(rows)
        assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
        kept = {r.doc_id for r in near_dedup.deduplicated(docs).collect()}
        assert kept == {d for d, _, _, k in brute(rows) if k} | {None}


def test_rest_finds_what_rounds_leave(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.groups_of(docs, rounds=0).collect()} == brute(rows)


def test_blocks_meet(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rest = near_dedup.rest_links
    monkeypatch.setattr(near_dedup, "rest_links", lambda *x: rest(*x, block=2000))
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    assert {tuple(r) for r in near_dedup.groups_of(docs, rounds=0).collect()} == brute(rows)


def test_empty(spark):
    assert near_dedup.groups_of(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)]
    random.Random(1).shuffle(edges)
    for task_edges in (20, 500_000):
        got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "u long, v long"), task_edges).collect()))
        assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
