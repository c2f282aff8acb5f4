import hashlib
import random
import re

from millrace.llm import decontaminate


def words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(docs, items, size=8):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocab = ["the", "of", "Ä", "x1", "é"] + [f"v{k}" for k in range(30)]
    text = lambda n: r.choice([" ", "-", " ,"]).join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randint(1, 20))) for k in range(12)] + [(20, None), (21, ""), (22, "the"), (23, "the of"), (24, "the the the the the the the the the"), (25, "of the of"), (None, "v1 v2")]
    items.append((30, items[3][1]))
    docs = [(0, None), (1, ""), (2, "..."), (3, "the the the the the the the the the the"), (4, "THE of")]
    for k in range(60):
        t = text(r.randint(1, 80))
        if k % 3 == 0:
            t = f"({t}) {items[r.randrange(12)][1]}. {items[r.randrange(12)][1]}"
        docs.append((k + 5, t))
    docs += [docs[8], docs[8], (None, items[0][1])]
    items = [(i, t) for i, t in items if i is not None]
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(a, b).drop("row").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs, items), key=repr)
    assert any(r.n_items > 1 for r in got)


def test_large_sides_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW", 0)
    monkeypatch.setattr(decontaminate.few, "__defaults__", (0,))
    docs = [(1, "a b c d e f g h i j"), (2, "a b c d e f g x")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "z b c d e f g h i")], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 8, 2: 0}


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red x green blue"), (3, "red x x x green blue")], "doc_id long, text string")
    terms, _ = decontaminate.windows_of(items)
    index = decontaminate.index_of(docs, terms)
    near = lambda slack: {r.doc_id for r in decontaminate.matches(index, terms, slack).join(index.select("row", "doc_id").distinct(), "row").collect()}
    assert near(0) == {1}
    assert near(1) == {1, 2}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = decontaminate.contamination(docs, items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
