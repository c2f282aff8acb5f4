import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import sse, state


def events(spark):
    r = random.Random(1)
    rows = [(k % 3, k, 1000 + k * r.randint(1, 40), r.random() < 0.6, r.random() < 0.3) for k in range(200)]
    return spark.createDataFrame(rows, "user long, event_id long, ms long, ok boolean, retry boolean")


CASES = [
    (lambda: state.TokenBucket(5, 3), "admitted boolean, level double"),
    (lambda: state.Breaker(2, 500), "passed boolean, state string"),
    (lambda: state.RollingBreaker(1500, 4, 0.5, 700), "passed boolean, state string"),
    (lambda: state.RetryBudget(0.3, 3), "allowed boolean, left double"),
]


def test_token_bucket_by_hand():
    b = state.TokenBucket(rate=1, burst=2)
    assert [b.step(ms, {})["admitted"] for ms in (0, 0, 0, 999, 1000, 5000, 5000, 5000)] == [True, True, False, False, True, True, True, False]


def test_breaker_by_hand():
    b = state.Breaker(limit=2, cooldown=100)
    steps = [(0, False), (1, False), (50, True), (101, False), (150, True), (201, True), (202, False)]
    assert [b.step(ms, {"ok": ok})["state"] for ms, ok in steps] == ["closed", "open", "open", "open", "open", "closed", "closed"]


def test_prefix_cache_by_hand():
    c = state.PrefixCache(ttl=100, least=10)
    ask = lambda ms, *blocks: c.step(ms, {"digests": list(blocks), "sizes": [10] * len(blocks)})
    assert ask(0, "a", "b")["written"] == 20
    assert ask(50, "a", "b", "c") == {"cached": 20, "written": 10, "billed": 14.5}
    assert ask(149, "a", "b", "c")["cached"] == 30
    assert ask(300, "a", "b", "c")["cached"] == 0


@pytest.mark.parametrize("fold,out", CASES)
def test_stream_equals_batch(spark, tmp_path, fold, out):
    rows = events(spark)
    want = {tuple(r) for r in state.batch(rows, "user", fold, out).collect()}
    for k in range(3):
        rows.where(F.floor(F.col("event_id") / 67) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = state.stream(source, "user", fold, out).writeStream.format("memory").queryName("folded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == want


WIRE = "\ufeffevent: a\r\ndata: é1\r\ndata: 2\r\n\r\n: note\ndata:x\nid: 7\nretry: 30\n\nevent: none\n\ndata: lost".encode()
WANT = [("a", "é1\n2", None, None), ("message", "x", "7", 30)]


def test_any_chunks_give_the_same_events(spark):
    rows, r = [], random.Random(2)
    for k in range(20):
        at = 0
        while at < len(WIRE):
            n = r.randint(1, 9)
            rows.append((k, at, bytearray(WIRE[at : at + n])))
            at += n
    got = sse.events_of(spark.createDataFrame(rows, "stream_id long, seq long, bytes binary")).collect()
    for k in range(20):
        assert [tuple(x)[2:] for x in sorted(got, key=lambda x: x.n) if x.stream_id == k] == WANT


def test_every_prefix_of_json_is_completed():
    value = {"a": [1, -2.5e3, {"b": "x\"\\é\n"}], "c": True, "d": None, "e": {}, "f": [], "g": "end"}
    text = json.dumps(value)
    assert sse.completed(text) == ("complete", value)
    for k in range(1, len(text)):
        assert sse.completed(text[:k])[0] == "partial", text[:k]
    assert sse.completed('{"a": [1, 2') == ("partial", {"a": [1, 2]})
    assert sse.completed('{"a": "b", "c') == ("partial", {"a": "b"})
    assert sse.completed('{"a": tr') == ("partial", {"a": True})
    assert sse.completed("[1 2]")[0] == "unparseable"
