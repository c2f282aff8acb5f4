import json
import random
import re

import pytest

from millrace.functions import parsing as P
from millrace.operators import records


def test_layers():
    assert P.lenient('{"a": 1}') == ("strict", {"a": 1})
    assert P.lenient('x\n```json\n{"a": 1}\n```') == ("fence", {"a": 1})
    assert P.lenient('well: {"a": "}"} ok') == ("extract", {"a": "}"})
    assert P.lenient('{"a": [1, 2,], "b": ",}",}') == ("commas", {"a": [1, 2], "b": ",}"})
    assert P.lenient("{'a': None, 'b': True}") == ("literal", {"a": None, "b": True})
    assert P.lenient("nothing") == P.lenient(None) == P.lenient("[1]") == (None, None)


def test_marks():
    assert P.marked("a ⟦X⟧bc⟦/⟧ d") == ("a bc d", [(2, 4, "X", "bc")])
    for bad in ("⟦X⟧a", "a⟦/⟧", "⟦X⟧a⟦Y⟧b⟦/⟧", "a⟦"):
        with pytest.raises(ValueError):
            P.marked(bad)


def test_sentences():
    t = 'One two. "Three four!" It is e.g. Five. six 7 approx. Eight? 9 ends'
    assert [t[a:b] for a, b in P.sentences(t)] == ["One two.", '"Three four!"', "It is e.g. Five. six 7 approx. Eight?", "9 ends"]
    assert P.sentences("") == P.sentences(None) == P.sentences("  ") == []


def windows(text, size, overlap):
    """The definition, word by word."""
    at = [m.span() for m in re.finditer(r"\S+", text or "")]
    out, k = [], 0
    while at:
        out.append((at[k][0], at[min(k + size, len(at)) - 1][1]))
        if k + size >= len(at):
            break
        k += size - overlap
    return out


def test_fixed_chunks(spark):
    r = random.Random(1)
    texts = [None, "", "  ", "alone", " pear  plum\nfig ", *["".join(r.choice(["kiwi", "é", " ", "\n", "  "]) for _ in range(r.randint(0, 40))) for _ in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((3, 0), (4, 2), (1, 0), (50, 10)):
        got: dict = {}
        for x in records.fixed_chunks(docs, size, overlap).collect():
            assert x.text == texts[x.doc_id][x.start : x.end]
            got.setdefault(x.doc_id, []).append((x.start, x.end))
        assert all(sorted(got.get(i, [])) == windows(t, size, overlap) for i, t in enumerate(texts))


def test_sentence_chunks():
    t = "Rain fell. Rivers rose fast. Nobody in the valley had seen it before. Stop. Go."
    got = [t[a:b] for a, b in P.sentence_chunks(t, 5)]
    assert got == ["Rain fell. Rivers rose fast.", "Nobody in the valley had seen it before.", "Stop. Go."]
    assert P.sentence_chunks(None, 5) == P.sentence_chunks("", 5) == []


def test_normal_forms():
    assert P.normalized(" Ｇroße\tÄpfel ") == "grosse äpfel"
    assert P.joined_letters("say h e l l o to a b") == "say hello to a b"
    assert P.hidden_base64("see bm90aGluZyBpcyBoaWRkZW4gaGVyZQ== end") == ["nothing is hidden here"]
    assert P.generic("p.q[3].r[0]") == "p.q[].r[]"


def test_leaf_comparison(spark):
    gold = {"n": 1, "items": [{"q": 2}, {"q": 3}], "x": None, "y": "a"}
    said = {"n": 1, "items": [{"q": 2}, {"q": 4}], "y": "a", "z": True}
    rows = lambda v: records.flattened(spark.createDataFrame([(1, json.dumps(v))], "id long, json string"))
    t = records.compared(rows(gold), rows(said))
    assert {tuple(r) for r in t.collect()} == {("n", 1, 0, 0, 0), ("items[].q", 1, 1, 0, 0), ("x", 0, 0, 1, 0), ("y", 1, 0, 0, 0), ("z", 0, 0, 0, 1)}
    m = records.micro(t).first()
    assert (m.precision, m.recall) == (0.6, 0.6)
