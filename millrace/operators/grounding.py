"""How far a claim is supported by its context, answers taken from sentences, and summaries of evicted turns.

A context's sentences, their TF-IDF weights and the context's numbers are made once for each row; everything is a
function of one row (claim and context, question and documents, or a turn's text), so there is no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions import parsing
from millrace.functions.text import STOPWORDS

NEGATIONS = frozenset({"not", "no", "never", "cannot", "without", "nor", "none"})  #: fixed values
NUMBER = re.compile(r"(?<![\w.])\d+(?:\.\d+)?")
CLAIMS = "id long, overlap double, cosine double, numeric double, gated double, negation double, best string"
LEAST_OVERLAP = 0.35  #: fixed value: an answer with less is refused
SHARE, USES, GAP, SUMMARY = 0.25, 2, 4, "Earlier: "


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", parsing.normalized(text))


def content(text: str) -> set[str]:
    return {w for w in words(text) if w not in STOPWORDS}


def numbers(text: str) -> set[float]:
    """Numbers that stand by themselves, thousands joined."""
    return {float(x) for x in NUMBER.findall(re.sub(r"(?<=\d),(?=\d)", "", text))}


def negated(text: str) -> bool:
    return any(w in NEGATIONS for w in words(text))


def sentences(text: str) -> list[str]:
    return [text[i:j] for i, j in parsing.sentences(text)]


def best_sentence(claim: str, every: list[str]) -> tuple[float, str | None]:
    """The greatest TF-IDF cosine of the claim to a sentence, weights being those of these sentences, and the sentence."""
    counts = [Counter(words(s)) for s in every]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(every)) / (1 + n)) + 1 for t, n in df.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = {t: n * idf[t] for t, n in Counter(words(claim)).items() if t in idf}
    best, found = 0.0, None
    for s, c in zip(every, counts):
        v = {t: n * idf[t] for t, n in c.items()}
        dot = sum(x * v[t] for t, x in q.items() if t in v)
        score = round(min(1.0, dot / (size(q) * size(v))), 12) if dot else 0.0
        if score > best:
            best, found = score, s
    return best, found


def judged(claim: str, context: str) -> tuple[float, float, float, float, float, str | None]:
    """overlap: share of the claim's content words that the context has (none: 0); cosine: to the nearest sentence;
    numeric: share of the claim's numbers that the context has (none: 1); gated: the lesser of cosine and numeric;
    negation: gated, or 0 where only one of claim and nearest sentence is negated."""
    c = content(claim)
    overlap = len(c & content(context)) / len(c) if c else 0.0
    cosine, best = best_sentence(claim, sentences(context))
    n = numbers(claim)
    numeric = len(n & numbers(context)) / len(n) if n else 1.0
    gated = min(cosine, numeric)
    return overlap, cosine, numeric, gated, 0.0 if best is not None and negated(claim) != negated(best) else gated, best


def grounded(claims: DataFrame) -> DataFrame:
    """(id, overlap, cosine, numeric, gated, negation, best) of claims (id, claim, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *judged(c or "", x or "")) for i, c, x in zip(*[col.to_pylist() for col in b.columns])]
            kinds = [pa.int64(), *[pa.float64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=[f.split()[0] for f in CLAIMS.split(", ")])

    return claims.select("id", "claim", "context").mapInArrow(run, CLAIMS)


def answer(question: str, texts: list[str], least: float = LEAST_OVERLAP) -> tuple[float, str | None]:
    """(overlap, sentence): the sentence that has the greatest share of the question's content words, the first of
    several; no sentence if that is less than the floor."""
    q = content(question)
    best, found = 0.0, None
    for text in texts:
        for s in sentences(text):
            share = len(q & content(s)) / len(q) if q else 0.0
            if share > best:
                best, found = share, s
    return best, found if best >= least else None


def answered(questions: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(id, overlap, answer) of questions (id, question, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *answer(q or "", t or [], least)) for i, q, t in zip(*[c.to_pylist() for c in b.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.float64(), pa.string()))], names=["id", "overlap", "answer"])

    return questions.select("id", "question", "texts").mapInArrow(run, "id long, overlap double, answer string")


def significant(every: list[str], uses: int = USES) -> set[str]:
    """Content words that occur at least so often."""
    return {w for w, n in Counter(w for s in every for w in words(s) if w not in STOPWORDS).items() if n >= uses}


def cluster_score(sentence: str, wanted: set[str], gap: int = GAP) -> float:
    """The best count^2 / span of a run of significant words with at most `gap` others between two of them."""
    at = [i for i, w in enumerate(words(sentence)) if w in wanted]
    best, first = 0.0, 0
    for k in range(len(at)):
        if k and at[k] - at[k - 1] - 1 > gap:
            first = k
        n, span = k - first + 1, at[k] - at[first] + 1
        best = max(best, n * n / span)
    return best


def tokens(text: str) -> int:
    return max(1, math.ceil(len(text) / 4))


def summary(texts: list[str], budget: int) -> str:
    """Sentences by falling score that still fit a budget of tokens, in their old order; ones that don't are skipped."""
    every = [s for t in texts for s in sentences(t)]
    wanted = significant(every)
    room, kept = budget - tokens(SUMMARY), []
    for k in sorted(range(len(every)), key=lambda k: (-cluster_score(every[k], wanted), k)):
        cost = tokens(every[k] + " ")
        if cost <= room:
            kept.append(k)
            room -= cost
    return SUMMARY + " ".join(every[k] for k in sorted(kept)) if kept else ""


def assembled(turns: list[tuple[str, str]], budget: int, share: float = SHARE) -> tuple[str, int]:
    """(summary of evicted turns, number of turns kept): the newest turns that fit; if some don't and the summary's share
    of the budget exceeds its heading, the tail gets the rest of it and what is evicted is summed up."""

    def tail(room: int) -> int:
        kept = 0
        for _, text in reversed(turns):
            room -= tokens(text)
            if room < 0:
                break
            kept += 1
        return kept

    kept = tail(budget)
    part = int(budget * share)
    if kept == len(turns) or part <= tokens(SUMMARY):
        return "", kept
    kept = tail(budget - part)
    return summary([t for _, t in turns[: len(turns) - kept]], part), kept


def assembled_contexts(conversations: DataFrame, budget: int = 300) -> DataFrame:
    """(conv_id, turns, kept, summary) of conversations (conv_id, turns: array of (turn, role, text))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(t["role"] or "", t["text"] or "") for t in turns]
                text, kept = assembled(rows, budget)
                out.append((c, len(rows), kept, text))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], names=["conv_id", "turns", "kept", "summary"])

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id long, turns int, kept int, summary string")
