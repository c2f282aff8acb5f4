"""Operators that SQL can't check, against brute force, pinned cases and what has to hold."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import digests
from millrace.functions import text as T
from millrace.operators import evaluation, extraction, features, gates, grounding, pruned, rerank, retrieval, stats, vectors
from millrace.sources import contracts, generators


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_variants_of_a_word_share_a_stem(spark):
    for group in (("cache", "caching", "cached"), ("delete", "deleted", "deleting", "deletes"), ("stores", "stored", "store"), ("kill", "killed", "killing"), ("pass", "passed", "passing"), ("processes", "process")):
        assert len(set(column(spark, T.stem, *group))) == 1, group
    assert column(spark, T.stem, "stopped", "running", "queries", "class", "ssh", "git") == ["stop", "run", "query", "class", "ssh", "git"]
    assert column(spark, T.stemmed, "use --force-with-lease") == [["use", "force-with-leas", "forc", "leas"]]


def test_fnv1a_takes_utf16_units(spark):
    def brute(s):
        h = 2166136261
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
        return h

    texts = ["", "a", "héllo", "🙂x", "漢字"]
    assert column(spark, T.fnv1a, *texts) == [brute(t) for t in texts]


def test_running_sums_over_partitions(spark):
    r = random.Random(1)
    rows = [(r.random(), k, r.randint(0, 9)) for k in range(500)]
    got = stats.running(spark.createDataFrame(rows, "x double, k long, v long").repartition(5), [F.desc("x"), F.asc("k")], {"v": "upto"}).collect()
    want, total = {}, 0
    for x, k, v in sorted(rows, key=lambda t: (-t[0], t[1])):
        total += v
        want[k] = total
    assert {g.k: g.upto for g in got} == want
    assert stats.running(spark.createDataFrame([], "k long, v long"), ["k"], {"v": "upto"}).collect() == []


def matching(gold, said):
    """Greedy pairs of element dicts by falling F1, then places."""
    scores = []
    for i, g in gold.items():
        for j, s in said.items():
            same = sum(s.get(p) == v for p, v in g.items())
            if same:
                scores.append((-round(2 * same / (len(g) + len(s)), 9), i, j))
    out, left, right = set(), set(), set()
    for _, i, j in sorted(scores):
        if i not in left and j not in right:
            out.add((i, j))
            left.add(i)
            right.add(j)
    return out


def test_arrays_are_aligned(spark):
    r = random.Random(2)
    every, gold_rows, said_rows = {}, [], []
    for i in range(30):
        make = lambda: {k: {p: str(r.randint(0, 3)) for p in "abc"[: r.randint(1, 3)]} for k in range(r.randint(0, 5))}
        every[i] = make(), make()
        gold_rows += [(i, k, p, v) for k, e in every[i][0].items() for p, v in e.items()]
        said_rows += [(i, k, p, v) for k, e in every[i][1].items() for p, v in e.items()]
    kind = "id long, element long, path string, value string"
    gold, said = spark.createDataFrame(gold_rows, kind), spark.createDataFrame(said_rows, kind)
    got = extraction.aligned(extraction.element_scores(gold, said))
    pairs = {}
    for x in got.collect():
        pairs.setdefault(x.id, set()).add((x.gi, x.pi))
    assert all(pairs.get(i, set()) == matching(*every[i]) for i in every)
    again = extraction.realigned(said, got)
    assert again.count() == len(said_rows) and again.where("element < 0").count() == sum(len(e) for i in every for k, e in every[i][1].items() if k not in {j for _, j in pairs.get(i, ())})


def test_long_arrays_and_many_records_are_aligned(spark, monkeypatch):
    """Ties, chains that outlast the rounds, records that span batches, records without id."""
    r = random.Random(4)
    rows = [(None if i == 7 else i, x, y, r.choice([0.25, 0.5, 1.0])) for i in range(60) for x, y in r.sample([(x, y) for x in range(9) for y in range(9)], r.randint(1, 60))]
    rows += [(1000, k // 2, (k + 1) // 2, 1 - k / 64) for k in range(50)]
    want = set()
    for i in {x[0] for x in rows}:
        left, right = set(), set()
        for _, x, y, f in sorted((x for x in rows if x[0] == i), key=lambda x: (-x[3], x[1], x[2])):
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                want.add((i, x, y, f))
    table = spark.createDataFrame(rows, "id long, gi long, pi long, f1 double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for rounds, pairs in ((8, 20), (1, 1 << 17)):
            monkeypatch.setattr(extraction, "ROUNDS", rounds)
            monkeypatch.setattr(extraction, "PAIRS", pairs)
            got = [tuple(x) for x in extraction.aligned(table).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_values_that_match_share_a_key(spark):
    said = ['"5"', '"\\t5"', "5", "5.0", "-0", "0", '"-0.0"', '"$5"', '"5 "', '"a  B"', '"A b"', '"ß"', '"SS"', '"Jan 5, 2024"', '"2024-01-05"', '" 2024-01-05"', '"\\t2024-01-05"', "null", '"null"', "true", "1e5", '"1e5"', "100000", '""', "{}", None]
    t = spark.createDataFrame(list(enumerate(said)), "element long, value string").selectExpr("1L as id", "element", "'p' as path", "value")
    for upto in extraction.LADDER:
        x, y = t.selectExpr("element as gi", "value as g"), t.selectExpr("element as pi", "value as s")
        want = {(a.gi, a.pi) for a in x.crossJoin(y).where(extraction.values_match(F.col("g"), F.col("s"), upto)).collect()}
        got = [(a.gi, a.pi, a.f1) for a in extraction.element_scores(t, t, upto).collect()]
        assert {a[:2] for a in got} == want and len(got) == len(want) and {a[2] for a in got} == {1.0}
    big = spark.range(30_000).selectExpr("1L as id", "id as element", "'p' as path", "cast(id as string) as value")
    assert extraction.element_scores(big, big).count() == 30_000


def test_the_ladder_of_equalities(spark):
    cases = [
        ('"$1,234.50"', "1234.5", "numeric", True), ('"$1,234.50"', "1234.5", "exact", False), ("42", '"42abc"', "text", False), ('"Jan 5, 2024"', '"2024-01-05"', "date", True),
        ('"Jan 5, 2024"', '"2024-01-05"', "numeric", False), ('"Straße  X"', '"strasse x"', "text", True), ('"05/01/2024"', '"2024-01-05"', "text", False), ("null", "null", "exact", True), ("true", '"true"', "text", False),
    ]
    for upto in extraction.LADDER:
        rows = spark.createDataFrame([(g, s, w) for g, s, u, w in cases if u == upto], "g string, s string, w boolean")
        assert all(r.got == r.w for r in rows.select("w", extraction.values_match(F.col("g"), F.col("s"), upto).alias("got")).collect())


def test_first_attempt_that_fits(spark):
    rows = [(1, 0, "no"), (1, 1, '{"a": 1, "b": ""}'), (1, 2, 'x {"a": 1, "b": 2,}'), (2, 0, "no"), (3, 0, '{"b": 1, "a": 2}'), (3, 1, '{"a": 9, "b": 9}')]
    got = {r.id: (r.attempt, r.json) for r in extraction.extracted(spark.createDataFrame(rows, "id long, attempt int, text string"), ("a", "b")).collect()}
    assert got == {1: (2, '{"a":1,"b":2}'), 2: (None, None), 3: (0, '{"a":2,"b":1}')}


def test_grounding():
    context = "The cache holds 10,000 rows. It is never written to disk. Version v1.2 was first."
    overlap, cosine, numeric, gated, negation, best = grounding.judged("The cache holds 10000 rows", context)
    assert (overlap, numeric, best) == (1 if "10000" in grounding.content(context) else 3 / 4, 1.0, "The cache holds 10,000 rows.")
    assert gated == cosine > 0.5 and negation == gated
    assert grounding.judged("It is written to disk", context)[4] == 0.0  # one is negated, the other isn't
    assert grounding.judged("The cache holds 12 rows", context)[2:4] == (0.0, 0.0)
    assert grounding.judged("of the", context)[0] == 0.0 and grounding.judged("", "")[1:] == (0.0, 1.0, 0.0, 0.0, None)
    assert grounding.numbers("p99 v1.2 3 4.0 1,200") == {3.0, 4.0, 1200.0}


def test_answers_and_summaries():
    texts = ["Cats sleep. Dogs bark at night.", "Dogs bark loudly at night and day."]
    assert grounding.answer("When do dogs bark at night?", texts)[1] == "Dogs bark at night."
    assert grounding.answer("Who wrote the treaty of Utrecht?", texts)[1] is None
    assert grounding.cluster_score("alpha x y beta z z z z z alpha", {"alpha", "beta"}) == 1.0 and grounding.cluster_score("alpha beta", {"alpha", "beta"}) == 2.0
    turns = [("user", f"Topic {k} is river water. Nothing else here.") for k in range(30)]
    text, kept = grounding.assembled(turns, 120)
    assert 0 < kept < 30 and text.startswith(grounding.SUMMARY) and grounding.tokens(text) <= 40
    assert grounding.assembled(turns[:2], 120) == ("", 2)


def test_semantic_cache():
    c = features.SemanticCache(0.7, 0.1)
    assert c.lookup("how do i reset my password")[0] == "miss"
    c.insert("how do i reset my password", 1)
    c.insert("what does the premium plan cost", 2)
    assert c.lookup("how do i reset my password") == ("exact", 1, 1.0)
    kind, answer, score = c.lookup("how do i reset my password please")
    assert (kind, answer) == ("near", 1) and 0.7 <= score < 1
    assert c.lookup("where is the office")[0] == "miss"
    c.insert("how do i reset my password now", 3)
    assert c.lookup("how do i reset my password please")[0] == "miss"  # two answers are too near to each other


def test_latent_space(spark):
    docs = spark.createDataFrame([(0, "car engine wheel"), (1, "engine wheel motor"), (2, "apple pear fruit"), (3, "pear fruit plum"), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "car"), (1, "plum")], "query_id long, text string")
    space = rerank.term_space(docs, 50, 2)
    got = {(r.query_id, r["rank"]): r.doc_id for r in rerank.lsa(docs, queries, 2, space).collect()}
    assert {got[0, 1], got[0, 2]} == {0, 1} and {got[1, 1], got[1, 2]} == {2, 3}  # 1 and 2 share no word with their query
    x = np.array([[math.log(1) + 1 if t in d.split() else 0 for t in space.terms] for d in ("car engine wheel", "engine wheel motor", "apple pear fruit", "pear fruit plum")]) * space.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, size, _ = np.linalg.svd(x)
    assert np.allclose(np.linalg.norm(x @ space.vectors, axis=0), size[:2])
    short = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 0, 3)], "query_id long, doc_id long, rank int")
    values = rerank.maxsim_values(short, docs, queries, space)
    assert {r.doc_id: r["rank"] for r in rerank.reranked(short, values, 3).collect()}[2] == 3


def test_pruning_gives_the_same_lists_for_less(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(30))) for k in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(k, f"w{r.randint(1, 3)} w{r.randint(20, 60)}") for k in range(12)], "query_id long, text string")
    want = sorted(map(tuple, retrieval.bm25(docs, queries, 3).collect()))
    for f in (pruned.wand, pruned.maxscore, pruned.block_max):
        assert sorted(map(tuple, f(docs, queries, 3).collect())) == want
    work = pruned.work(docs, queries, 3).agg(F.sum("postings"), F.sum("scored")).first()
    assert work[1] < work[0]


def test_gates(spark):
    r = random.Random(5)
    worse = [(k, "ab"[k % 2], 1, int(r.random() > (0.3 if k % 2 else 0.0))) for k in range(400)]
    same = [(k, "ab"[k % 2], b := int(r.random() > 0.2), b) for k in range(400)]
    kind = "item long, slice string, old int, new int"
    v = gates.verdicts(gates.resampled(spark.createDataFrame(worse, kind))).first()
    assert all([v.naive, v.ci, v.slice, v.combined, v.bonferroni, v.bh, v.combined_bh])
    v = gates.verdicts(gates.resampled(spark.createDataFrame(same, kind))).first()
    assert not any([v.naive, v.ci, v.slice, v.combined, v.combined_bh])
    runs = spark.createDataFrame([("r1", *x) for x in worse] + [("r2", *x) for x in same], "run string, " + kind)
    assert {x.gate: x.failures for x in gates.failure_rates(runs, rounds=60).collect()} == {"naive": 1, "ci": 1, "slice": 1}
    with pytest.raises(ValueError):
        gates.compared(spark.createDataFrame([(1, "a", 1)], "item long, slice string, ok int"), spark.createDataFrame([(2, 1)], "item long, ok int"))


def test_generators_are_repeatable(spark):
    one, two = generators.corpus(spark, 40, 7), generators.corpus(spark, 40, 7).repartition(3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, generators.corpus(spark, 40, 8).collect()))
    assert all(40 <= len(r.text.split()) <= 120 for r in one.collect())
    v = generators.clustered(spark, 300, 4, 3, 1, 0.05).collect()
    centre = {k: np.mean([r.embedding for r in v if r.label == k], axis=0) for k in {r.label for r in v}}
    assert len(centre) == 3 and all(np.linalg.norm(np.array(r.embedding) - centre[r.label]) < 0.5 for r in v)
    t = generators.traffic(spark, 2000, 20, 3).collect()
    assert 0.05 < sum(r.typoed for r in t) / 2000 < 0.15 and 0.12 < sum(r.greeted for r in t) / 2000 < 0.28
    gap = generators.arrivals(spark, 500, 20.0, 2).orderBy("id").collect()
    assert 15 < gap[-1].at_ms / 500 < 25 and all(b.at_ms > a.at_ms for a, b in zip(gap, gap[1:]))
    data = bytes(range(256)) * 5
    parts = generators.chunks_of(data, 3, 40)
    assert b"".join(parts) == data and max(map(len, parts)) <= 40 and parts == generators.chunks_of(data, 3, 40)
    talk = generators.conversations(spark, 3, 20, 3, 1).collect()
    assert {r.probe for r in talk if r.probe is not None} == {0, 1, 2} and all(r.role == "user" for r in talk if r.fact is not None)
    pairs = generators.graded_pairs(spark, 100, 1).collect()
    assert all((p.quality_a > p.quality_b) == (p.gold == "a") for p in pairs) and sum(p.gold == "a" for p in pairs) == 50


def test_texts_are_damaged(spark):
    text = "The quick brown fox jumps over the lazy dog again and again. It sleeps. Then it runs away!"
    docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id long, text string")
    key = F.col("doc_id")
    rows = docs.select(generators.typed_wrong(F.col("text"), key, 1, 0.05).alias("t"), generators.swapped_letters(F.col("text"), key).alias("s"), generators.noisy(F.col("text"), key).alias("n")).collect()
    assert all(r.t != text for r in rows[:3]) and all(abs(len(r.t) - len(text)) < 12 for r in rows)
    assert all(r.s != text and sorted(r.s) == sorted(text) for r in rows if r.s != text) and sum(r.s != text for r in rows) > 30
    assert all("".join(r.n.lower().split()) == "".join(text.lower().split()) and r.n != text for r in rows)
    for r in generators.reordered(docs, 2).collect():
        assert r.text != text and sorted(r.text.split()) == sorted(text.split())


def test_contracts(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")
        return str(tmp_path / name)

    corpus = write("corpus.jsonl", [{"id": "a", "title": "A", "text": "x y"}, "", {"id": "b", "title": "B", "text": "z"}])
    docs = contracts.load(spark, corpus, "corpus")
    assert {tuple(r) for r in contracts.titled(docs).collect()} == {("a", "A\nx y"), ("b", "B\nz")}
    queries = write("queries.jsonl", [{"query": "x", "relevant": ["a"]}, {"query": "y", "relevant": ["b", "q"]}])
    with pytest.raises(ValueError, match="line 2, y: relevant names nothing in corpus: q"):
        contracts.load(spark, queries, "queries", {"corpus": docs})
    for bad, fault in (("not json", "not an object"), ({"id": "", "title": "A", "text": "x"}, "id is filled"), ({"id": "b", "title": "B", "text": "z"}, "the key is repeated")):
        path = write("bad.jsonl", [{"id": "b", "title": "B", "text": "z"}, bad])
        with pytest.raises(ValueError, match=f"line 2, .*{fault}"):
            contracts.load(spark, path, "corpus")
    golden = {"item_id": "1", "category": "c", "input_text": "i", "expected": "e", "distractor": "d", "difficulty": 0.5}
    assert contracts.load(spark, write("golden.jsonl", [golden]), "golden").count() == 1
    for change, fault in (({"more": 1}, "unknown fields: more"), ({"difficulty": 2.0}, "difficulty is in"), ({"distractor": " E "}, "distractor differs")):
        with pytest.raises(ValueError, match=fault):
            contracts.load(spark, write("golden.jsonl", [golden | change]), "golden")
    chunks = spark.createDataFrame([("1", "a", "x y"), ("2", "b", "y"), ("3", "b", "z")], "id string, doc_id string, answer string")
    rows = docs.select(F.col("id").alias("doc_id"), "text")
    assert {r.id for r in contracts.unique_answers(rows, chunks).collect()} == {"2"}
    hops = spark.createDataFrame([("1", "two_hop", "what about q", "a", "b", ["x", "z"])], "id string, kind string, question string, answer_id string, hop1_id string, bridge array<string>")
    assert {(r.token, r.fault) for r in contracts.bridged(docs, hops).collect()} == {("x", "not in the first hop's document"), ("z", "not in the answer's document")}


def test_run_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False)], "item long, slice string, ok boolean")
    contracts.save_run(rows, str(tmp_path / "run"), "first", "f00")
    head, back = contracts.load_run(spark, str(tmp_path / "run"))
    assert head == {"name": "first", "fingerprint": "f00", "n": 2, "right": 1} and back.count() == 2
    extra = tmp_path / "run" / "outcomes" / "part-extra.json"
    extra.write_text('{"item": 3, "slice": "b", "ok": true}\n')
    with pytest.raises(ValueError, match="the header says 1 of 2"):
        contracts.load_run(spark, str(tmp_path / "run"))


def test_measures(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "abstain"), (4, "b", "b")], "i long, gold string, said string")
    assert tuple(evaluation.decided(rows, "gold", "said").first()) == (4, 0.75, 0.666667, 0.625)
    assert evaluation.finalized(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()[3:] == (1.0, 1.0, 1.0)
    assert evaluation.selective(spark.createDataFrame([(True, 0.9)], "ok boolean, c double"), "ok", "c", [0.5, 0.95]).orderBy("threshold").collect()[1][1:] == (0, 0.0, 1.0)
    best = evaluation.best_of(spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "k long, v double"), "k", "v")
    assert {r.k for r in best.collect()} == {2, 3}


def test_grids_and_rogues(spark):
    e = generators.uniform_vectors(spark, 200, 6, 3)
    far = vectors.with_rogues(e, 2, 50.0, 6)
    wide, tight = vectors.grid(far, 16), vectors.grid(far, 16, 0.02)
    error = lambda g: vectors.rmse(e.select("vec_id", "embedding"), vectors.grid_decoded(vectors.grid_codes(e, 16, g), g)).agg(F.avg("rmse")).first()[0]
    assert error(tight) < error(wide) / 5
    assert vectors.total_bytes("grid4", 10, 7) == 10 * 4 + 56


def test_md5_of_many_numbers():
    for prefix in (b"0-*-", b"", b"199-\xc3\xa9-", b"x" * 51, b"y" * 80):
        want = [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(95, 10_050)]
        assert digests.digest_heads(prefix, 95, 10_050).tolist() == want


def test_resampling_packed_and_as_rows(spark, monkeypatch):
    """Differences of a slice go to tasks as bytes; larger slices as rows; null outcomes and slices among them."""
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "-c é", None]), r.choice([0, 1, 1, None]), r.choice([0, 1])) for i in range(400)]
    rows += [(1000 + i, "none", None, 1) for i in range(3)]
    table = spark.createDataFrame(rows, "item long, slice string, old int, new int").repartition(5)
    key = lambda x: sorted(map(tuple, x.collect()), key=repr)
    by_rows = lambda t: gates.resampled_means_by_rows(gates.with_all(t), 30)
    packed = lambda t: gates.resampled_means(gates.blocks(gates.with_all(t)), 30)
    assert key(packed(table)) == key(by_rows(table)) and len(key(packed(table))) == 30 * 5
    want = key(gates.resampled(table, 30))
    monkeypatch.setattr(gates, "PACKED", 100)
    assert key(gates.resampled(table, 30)) == want and len(want) == 5
