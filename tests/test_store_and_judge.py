"""Graph stores that change, pacing folds, judges."""

import numpy as np
import pytest

from millrace.operators import judge, store
from millrace.sources import generators
from millrace.streaming import pacing, state


def index(n=250, dim=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    g = store.MutableGraph(dim, 8, 40)
    g.insert(list(range(1000, 1000 + n)), x)
    return g, x


def test_tombstones_repair_and_compaction():
    g, x = index()
    assert g.live_recall(x[:20], 10, 80) > 0.9
    for k in range(0, 120):
        g.delete(k)
    assert len(g.live_ids()) == 130 and all(n >= 120 for q in x[:10] for _, n in g.search_live(q, 10, 200))
    assert g.live_recall(x[:20], 5, 250) > 0.9
    small, place = g.compact()
    assert small.live_ids() == g.live_ids() and place[120] == 0 and small.live_recall(x[:20], 5, 60) > 0.9
    r, _ = index()
    for k in range(0, 120):
        r.unlink_with_repair(k)
    assert len(r.reachable_live()) == 130 and r.live_recall(x[:20], 5, 80) > 0.9
    assert not any(n < 120 for links in r.links for layer in links for n in layer)
    bare, _ = index()
    hit = bare.attacks(4, 30)
    assert len({n for b in hit for n in b}) == 120 and len(bare.live()) == 130 and len(bare.reachable_live()) <= 130
    assert sum(bare.level_counts().values()) == 130 and set(bare.degrees()) == set(bare.live())
    assert sum(store.misses(bare, x[0], 10, 40).values()) == 10


def test_store_file(tmp_path):
    g, x = index(60)
    g.delete(3)
    g.unlink({5})
    path = str(tmp_path / "s.bin")
    size = store.save(g, path)
    back = store.load(path)
    assert size == (tmp_path / "s.bin").stat().st_size and back.links == g.links and (back.x == g.x).all() and back.live_ids() == g.live_ids()
    assert back.search(x[0], 5, 30) == g.search(x[0], 5, 30)
    data = store.to_bytes(g)
    for bad in (data[:-1], b"", data[:50] + bytes([data[50] ^ 1]) + data[51:], b"XXXX" + data[4:], data + b"\0"):
        with pytest.raises(ValueError):
            store.from_bytes(bad)
    assert store.from_bytes(store.to_bytes(store.MutableGraph(3))).live_ids() == []


def test_pacing(spark):
    p = pacing.Pacer(2.0)
    assert [p.step(0, {})["sent_ms"] for _ in range(3)] == [0, 500, 1000] and p.step(5000, {})["wait_ms"] == 0
    a = pacing.Aimd(10.0)
    assert [a.step(t, {"ok": ok})["rate"] for t, ok in ((0, True), (10, False), (20, False), (1500, False))] == [10.1, 5.05, 5.05, 2.525]
    h = pacing.Headers(100)
    for k in range(12):
        last = h.step(k * 100, {"remaining": 90 - k})  # a token each 100 ms goes, none comes
    assert last["estimate"] == 0.0
    b = pacing.Batches(3, 100)
    assert [b.step(t, {})["batch"] for t in (0, 1, 2, 3, 200, 250, 301)] == [0, 0, 0, 1, 2, 2, 3]
    rows = spark.createDataFrame([(1, k, 0, 10.0) for k in range(5)], "key long, event_id long, ms long, busy_ms double")
    got = state.batch(rows, "key", lambda: pacing.Probe(2), "start_ms double, end_ms double").orderBy("event_id").collect()
    assert [r.start_ms for r in got] == [0, 0, 10, 10, 20]
    assert pacing.retried([False, False, True], [100, 200], 0, 10) == {"ok": True, "attempts": 3, "sent_ms": [0, 110, 320], "end_ms": 330}
    assert pacing.retried([False] * 5, [100], 0, 10)["attempts"] == 2


def test_judges(spark):
    pairs = generators.graded_pairs(spark, 400, 2)
    fair = judge.Judge()
    assert {r.protocol: (r.coverage, r.accuracy) for r in judge.protocols(pairs, fair).collect()} == dict.fromkeys(("stored", "drawn", "both"), (1.0, 1.0))
    biased = judge.Judge(first=0.3)
    s = judge.direction_stats(judge.directions(pairs, biased)).first()
    assert s.to_second == 0 and s.to_first > 50 and s.lean > 0.1 and s.flip_rate == round(s.to_first / 400, 6)
    p = {r.protocol: r for r in judge.protocols(pairs, biased).collect()}
    assert p["both"].accuracy == 1.0 > p["stored"].accuracy and p["both"].calls == 800 and p["both"].coverage < 1
    assert judge.single_call_lean(pairs, biased).first().lean > 0.05
    b = judge.balanced(pairs).first()
    assert b.a_wins == b.b_wins == 200
    noisy = judge.Judge(noise=0.5, seed=3)
    again = [judge.directions(pairs.repartition(n), noisy).orderBy("id").collect() for n in (1, 4)]
    assert again[0] == again[1]
    assert 0 < judge.graded(pairs, noisy, 0.5).where("grade").count() < 400
