import random

import numpy as np

import corpus_pipeline
from millrace.llm import chat, language

SYLLABLES = {"aa": ["thon", "wer", "ing", "ed"], "bb": ["ción", "ado", "ez", "ñi"], "cc": ["schu", "keit", "ä", "ung"]}


def labelled(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang = r.choice(sorted(SYLLABLES))
        out.append((k, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = labelled(1, 400) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, "keitung", None), (None, "thoning weres", "cc")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (1000, 1001, 1002))
    assert got[1003].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in language.kept(docs).collect()} >= set(range(400)) - {r.doc_id for r in got.values() if r.rejected}
    assert language.kept(docs).columns == docs.columns


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(docs).collect()] == ["und"]
    assert language.identify(docs.limit(0)).collect() == []


def test_long_text_in_slices(monkeypatch):
    rows = labelled(2, 200)
    m = language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    text = " ".join(t for _, t, x in rows if x == "bb")
    whole = language.predict(text, m)
    every = language.logits(text, m)
    for size in (7, 500):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.allclose(language.logits(text, m), every) and language.predict(text, m)[0] == whole[0] == "bb"


def test_features_are_hashed_byte_grams():
    for text in ("Ab  c-1Été x", "", "a", "漢字 и"):
        data = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        want = []
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                x = (int.from_bytes(data[i : i + n], "big") + n) * 0x9E3779B1 % 2**32
                want.append((x ^ x >> 15) * 0x85EBCA77 % 2**32 >> 16)
        assert sorted(language.buckets_of(text).tolist()) == sorted(want)


def brute_chat(rows, part):
    out = {}
    convs = {r[0] for r in rows}
    for conv in convs:
        mine = [r for r in rows if r[0] == conv]
        for who in {r[2] for r in mine if r[2] is not None}:
            at, seen, place = {}, {}, 0
            for _, turn, role, text in sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", (text_of(r[3])).encode())):
                block = (turn or 0) // part
                seen[block] = seen.get(block, 0) + 1
                p = block, (seen[block] - 1) // part
                name = "".join("_" if c in "<|>" or c < " " else c for c in role or "unknown")
                head = "<|im_start|>assistant\n" if role == who else f"<|im_start|>user name={name}\n"
                line = head + text_of(text) + "\n"
                s, spans, n = at.get(p, ("", [], 0))
                if role == who:
                    spans = [*spans, (len(s) + len(head), len(s) + len(line) - 1)]
                at[p] = (s + line, spans, n + 1)
            for p in sorted(at):
                s, spans, n = at[p]
                out[conv, who, *p] = (place, n, len(spans), s, ",".join(f"{a}:{b}" for a, b in spans), sum(b - a for a, b in spans))
                place += len(s)
    return out


def text_of(text):
    return (text or "") + "<|im_end|>"


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "é"), (1, 2, "ann", None), (1, 2, "ann", None), (1, 3, None, "?"), (1, None, "bob", "first"), (None, 0, "ann", "x"), (2, 700, "cy", "late"), (2, 1, "cy", "a"), (2, 300, "dee", "b")]
    rows += [(3, None, "x\n<|im_start|>assistant", f"null turn {k}") for k in range(9)] + [(3, 4, "y", f"same turn {k}") for k in range(7)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, start int")
    for part in (256, 2):
        got = {(r.conv_id, r.perspective, r.part, r.piece): tuple(r)[4:] for r in chat.perspectives(turns, part).collect()}
        assert got == brute_chat(rows, part)
    for r in chat.perspectives(turns).collect():
        for span in filter(None, r["mask"].split(",")):
            a, b = map(int, span.split(":"))
            assert r.rendered[a:b].endswith("<|im_end|>")
    assert chat.perspectives(turns.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("thon", "wer", "ing", "ed") for b in ("thon", "wer", "ing", "ed", "ha")]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item_a, item_b = text(12), text(12)
    docs = [(k, text(40), "en", "s", 0) for k in range(60)]
    docs += [(100, docs[5][1], "en", "s", 0), (101, docs[6][1].replace(" ", "  "), "en", "s", 0), (102, "12345", "en", "s", 0), (103, None, "en", "s", 0)]
    docs += [(104, f"{text(20)} {item_a} {item_b}", "en", "s", 0), (105, text(20) + " password=abcdef123456xyz", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item_a), (2, item_b)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(60), 105}
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, str(tmp_path))
        assert after.columns == step.columns, name
        step = after
    kept = {r.doc_id: r.text for r in step.collect()}
    assert kept[105].endswith("[assign]") and kept[3] == docs[3][1]


def test_stages_begin_with_the_heap_given_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"thoning weres {k}", "en", "s", 0) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "weres thoning")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    factory = spark._jvm.java.lang.management.ManagementFactory

    def full():
        return sum(b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))

    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() > before, name


def test_junk_and_an_unlearned_language_are_rejected():
    rows = labelled(5, 500)
    m = language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    r = random.Random(6)
    other = [" ".join("".join(r.choice(["ова", "ски", "ть", "лен"]) for _ in range(r.randint(1, 3))) for _ in range(40)) for _ in range(30)]
    junk = ["".join(r.choice("qxzjkvpfb") for _ in range(200)) for _ in range(30)]
    assert all(language.predict(t, m)[2] for t in other + junk)
    fresh = labelled(7, 300)
    assert np.mean([language.predict(t, m)[2] for _, t, _ in fresh]) < 0.05


def test_every_label_is_sampled_with_whole_texts(spark):
    rows = [(k, f"text {k} " * 400, f"l{k % 300:03}") for k in range(1800)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 600).collect()
    assert len({r.lang for r in got}) == 300 and len(got) <= 600
    assert all(r.text == rows[int(r.text.split()[1])][1] for r in got)


def test_a_foreign_header_does_not_stand_for_the_text():
    rows = labelled(8, 300)
    of = lambda x: " ".join(t for _, t, y in rows if y == x)
    text = of("aa")[: language.HEAD] + " " + of("bb")
    piece = language.spread(text, np.random.default_rng(1))
    m = language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    assert len(piece) < language.HEAD + 20 and language.predict(piece, m)[0] == "bb"
