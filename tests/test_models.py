import random

import numpy as np

from millrace.operators import models


def naive_merges(pieces, merges):
    words = {tuple(p.encode()): n for p, n in pieces}
    out = []
    for k in range(merges):
        counts = {}
        for w, n in words.items():
            for pair in zip(w, w[1:]):
                counts[pair] = counts.get(pair, 0) + n
        if not counts or max(counts.values()) < 2:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append(best)
        new = {}
        for w, n in words.items():
            m, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    m.append(256 + k)
                    i += 2
                else:
                    m.append(w[i])
                    i += 1
            new[tuple(m)] = new.get(tuple(m), 0) + n
        words = new
    return out


def test_merges_and_round_trip(spark):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice(["th", "er", "é", "aa"]) for _ in range(r.randint(1, 4))) for _ in range(30)) + "  \n" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (100, "")], "doc_id long, text string")
    pieces = sorted((x.piece, x.n) for x in models.piece_counts(docs).collect())
    merges = models.learn_merges(pieces, 40)
    assert merges == naive_merges(pieces, 40)
    b = models.ByteBpe(merges)
    for t in [*texts, "漢字 new\tx"]:
        assert b.decode(b.encode(t)) == t
    small = b.truncated(5)
    assert all(i < 261 for i in small.encode(texts[0]))
    sizes = {x.doc_id: (x.n_bytes, x.n_tokens) for x in models.compression(docs, b).collect()}
    assert sizes[99] == sizes[100] == (0, 0) and sizes[0][1] < sizes[0][0]


def test_softmax_regression_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(3)
    got = models.fit_softmax(rows, "x", "y", 3, 3, steps=5)
    z, w = np.hstack([x, np.ones((60, 1))]), np.zeros((4, 3))
    for _ in range(5):
        p = models.softmax(z @ w)
        p[np.arange(60), y] -= 1
        w = w - 0.5 * (z.T @ p / 60 + 1e-3 * np.vstack([w[:-1], np.zeros((1, 3))]))
    assert np.allclose(got, w)


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4000, 4)) * 2
    y = np.array([rng.choice(4, p=p) for p in models.softmax(z)])
    assert abs(models.fit_temperature(z * 3, y) / models.fit_temperature(z, y) - 3) < 0.01
