"""Personal data, secrets, injection cues and groundedness as column expressions and small row operators."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

#: fixed values: what candidates of each kind look like
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE_ABROAD = r"\+[0-9][0-9 .()-]{6,18}[0-9]"
PHONE_HOME = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){11,18}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
SECRET = r"\b(?:sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[abp]-[A-Za-z0-9-]{10,})\b"
KEYLIKE = r"[A-Za-z0-9_\-+/=]{20,}"
ENTROPY = 4.0  #: bits a character from which a key-like run is a secret
PRIORITY = ("CARD", "SECRET", "SSN", "PHONE", "IP", "EMAIL")  #: of spans of equal start and length
#: fixed values: rules on normalised text, with category and weight; each counts once
RULES = (
    ("override.ignore-instructions", 3, r"\b(?:ignore|disregard|forget|drop)\b[^.!?\n]{0,50}?\b(?:previous|prior|above|earlier|original|all)\b[^.!?\n]{0,50}?\b(?:instructions?|rules?|prompts?|guidelines?|directives?)\b"),
    ("override.supersede", 3, r"\b(?:this message|the following|these instructions|my message)\b[^.!?\n]{0,40}?\b(?:overrides?|supersedes?|replaces?|takes? priority over)\b[^.!?\n]{0,40}?\b(?:instructions?|rules?|prompts?|configuration)\b"),
    ("exfiltration.system-prompt", 3, r"\b(?:reveal|show|print|repeat|output|display|share|paste|recite)\b[^.!?\n]{0,50}?\b(?:system|initial|hidden|original|secret|internal)\b[^.!?\n]{0,30}?\b(?:prompt|instructions?|message|rules?|configuration)\b"),
    ("exfiltration.ask-instructions", 2, r"\bwhat\b[^.!?\n]{0,30}?\b(?:are|were)\b[^.!?\n]{0,30}?\byour\b[^.!?\n]{0,30}?\b(?:instructions|rules|guidelines|system prompt)\b"),
    ("hijack.new-identity", 2, r"\byou are (?:now|no longer)\b"),
    ("hijack.no-rules-roleplay", 3, r"\b(?:pretend|imagine|act as if|behave as if|roleplay)\b[^.!?\n]{0,60}?\b(?:no (?:rules|restrictions|guidelines|filters)|unrestricted|without (?:any )?(?:rules|restrictions|filters|limits))\b"),
    ("hijack.developer-mode", 3, r"\b(?:developer mode|dan mode|jailbreak(?:ed|ing)? mode|god mode)\b"),
    ("smuggling.role-tag", 3, r"(?:^|\n)\s*(?:system|assistant)\s*:"),
    ("smuggling.chat-template", 4, r"<\|im_start\|>|\[\/?(?:inst|sys)\]|<<\/?sys>>"),
    ("smuggling.markdown-system", 2, r"(?:^|\n)#{1,4}\s*(?:system|new instructions)\b"),
)
PAYLOAD = "encoding.base64-payload", 2  #: fixed value: a base64 payload that fires a rule that hadn't
PATTERNS = [(name, weight, re.compile(p, re.A)) for name, weight, p in RULES]
#: fixed values: letters of other alphabets that look like Latin ones
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a"}
ZERO_WIDTH = re.compile("[\u200b-\u200d\u2060\ufeff]")
SPACED = re.compile(r"(?<![\w.-])(?:[a-z0-9][ .·_-]){3,}[a-z0-9](?![\w.-])", re.A)
BASE64 = re.compile(r"[A-Za-z0-9+/]{24,}={0,2}")
NEGATIONS = ("no", "not", "never", "none", "without", "cannot", "nor")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def candidates(text: str) -> Iterator[Span]:
    """Spans (start, end, type) of all kinds, overlaps and all. What stands before and behind a candidate must not make
    it a part of something longer."""

    def around(m: re.Match) -> tuple[str, str]:
        return text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]

    for m in re.finditer(CARD, text):
        digits, (before, after) = re.sub("[ -]", "", m[0]), around(m)
        if 13 <= len(digits) <= 19 and not re.search("[0-9-]", before + after) and re.match("4|5[1-5]|3[47]|6011|65", digits) and luhn(digits):
            yield m.start(), m.end(), "CARD"
    secrets = [m.span() for m in re.finditer(SECRET, text, re.A)]
    yield from ((i, j, "SECRET") for i, j in secrets)
    for m in re.finditer(KEYLIKE, text):
        if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and not any(m.start() < j and i < m.end() for i, j in secrets) and entropy(m[0]) >= ENTROPY:
            secrets.append(m.span())
            yield m.start(), m.end(), "SECRET"
    for m in re.finditer(SSN, text):
        v = m[0]
        if not re.search("[0-9-]", "".join(around(m))) and v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000":
            yield m.start(), m.end(), "SSN"
    for m in re.finditer(PHONE_ABROAD, text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15 and not re.search("[0-9]", "".join(around(m))):
            yield m.start(), m.end(), "PHONE"
    for m in re.finditer(PHONE_HOME, text):
        before, after = around(m)
        if not re.search("[0-9+]", before) and not re.search("[0-9]", after):
            yield m.start(), m.end(), "PHONE"
    for m in re.finditer(IP, text):
        before, after = around(m)
        cut = re.search("[0-9]", after) or (after == "." and re.match("[0-9]", text[m.end() + 1 : m.end() + 2]))
        if not re.search(r"[A-Za-z0-9_.]", before) and not cut and max(map(int, m[0].split("."))) <= 255:
            yield m.start(), m.end(), "IP"
    yield from ((m.start(), m.end(), "EMAIL") for m in re.finditer(EMAIL, text))


def detected(text: str) -> list[Span]:
    """Spans that don't overlap: of those that do the first stays, then the longer, then that of higher priority."""
    out: list[Span] = []
    for span in sorted(candidates(text), key=lambda s: (s[0], -s[1], PRIORITY.index(s[2]))):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, type, value) of all that is found; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, i, j, kind, t[i:j]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, j, kind in detected(t)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc_id", "start", "end", "type", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, end int, type string, value string")


def pii_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the number of spans of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [Counter(kind for _, _, kind in detected(t)) if t else Counter() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([c[k] for c in n], pa.int32()) for k in PRIORITY]], names=["doc_id", *map(str.lower, PRIORITY)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k.lower()} int" for k in PRIORITY))


def labelled(text: str) -> str:
    """The text with every detected span replaced by [TYPE_n]; equal values of a type have one n, by first occurrence."""
    labels: dict[tuple[str, str], str] = {}
    count: Counter = Counter()
    out, at = [], 0
    for i, j, kind in detected(text):
        key = kind, text[i:j]
        if key not in labels:
            count[kind] += 1
            labels[key] = f"[{kind}_{count[kind]}]"
        out += [text[at:i], labels[key]]
        at = j
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """Texts whose personal data and secrets, of all kinds, are replaced by labels; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(1, "text", pa.array([labelled(t.as_py() or "") for t in b.column(1)], pa.string()))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.schema)


def plain(text: str) -> str:
    """Text as rules read it: compatibility forms folded, invisible characters out, lower case, look-alike letters and
    digits within words read as letters, letters set apart by single signs joined."""
    out = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text)).lower()
    out = out.translate(str.maketrans(HOMOGLYPHS))
    out = re.sub(r"\S+", lambda m: m[0].translate(str.maketrans(T.LEET)) if re.search("[a-z]", m[0]) else m[0], out)
    return SPACED.sub(lambda m: re.sub("[ .·_-]", "", m[0]), out)


def printable(candidate: str) -> str | None:
    """What a base64 run decodes to, if that is twelve bytes or more, nine tenths of its characters printable."""
    run = candidate.rstrip("=")
    raw = base64.b64decode(run[: len(run) - (len(run) % 4 == 1)] + "=" * (-len(run) % 4 if len(run) % 4 != 1 else 0))
    text = raw.decode("utf-8", "replace")
    good = sum(c in "\t\n\r" or " " <= c < "\x7f" for c in text)
    return text if len(raw) >= 12 and good >= 0.9 * len(text) else None


def fired(text: str) -> list[tuple[str, int]]:
    """(rule, weight) of each rule that fires on a text or on what its base64 runs hold."""
    target = plain(text)
    hits = {name: weight for name, weight, p in PATTERNS if p.search(target)}
    for m in BASE64.finditer(text):
        inner = printable(m[0])
        if inner is not None:
            new = {name: weight for name, weight, p in PATTERNS if name not in hits and p.search(plain(inner))}
            if new:
                hits |= new | {PAYLOAD[0]: PAYLOAD[1]}
    return list(hits.items())


def injection_score(docs: DataFrame) -> DataFrame:
    """doc_id, score, rules: the sum of weights of the rules that fire, each once, and their names in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fired(t.as_py() or "") for t in b.column(1)]
            score, names = [float(sum(w for _, w in x)) for x in found], [",".join(sorted(n for n, _ in x)) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(names, pa.string())], names=["doc_id", "score", "rules"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, rules string")


def gated_runs(text: str, least: float = ENTROPY) -> list[tuple[str, float, bool]]:
    """Key-like runs with letters and digits, their bits a character, and whether they clear the gate."""
    runs = [m[0] for m in re.finditer(KEYLIKE, text) if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])]
    return [(r, round(entropy(r), 6), entropy(r) >= least) for r in runs]


def has_negation(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, NEGATIONS)))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, thousands joined."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: F.regexp_replace(x, ",", "").cast("double")))


def grounded(claims: DataFrame) -> DataFrame:
    """(id, overlap, numeric, negation): how far a claim is covered by its context: the share of content words, the
    share of numbers (none: 1), and whether both have or lack a negation."""
    rows = claims.select("id", T.content_words(F.col("claim")).alias("c"), T.content_words(F.col("context")).alias("x"), numbers(F.col("claim")).alias("n"), numbers(F.col("context")).alias("m"))
    share = lambda a, b, empty: F.when(F.size(a) == 0, empty).otherwise(F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.size(a))
    return rows.select("id", F.round(share(F.col("c"), F.col("x"), 0.0), 6).alias("overlap"), F.round(share(F.col("n"), F.col("m"), 1.0), 6).alias("numeric"), (has_negation(F.col("c")) == has_negation(F.col("x"))).alias("negation"))


def span_scores(gold: DataFrame, said: DataFrame) -> DataFrame:
    """Counts by type of exact span matches (doc_id, type, start, end), as multisets: tp, fp, fn."""
    key = ["doc_id", "type", "start", "end"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = n(gold, "g").join(n(said, "s"), key, "full").fillna(0, ["g", "s"])
    return both.groupBy("type").agg(F.sum(F.least("g", "s")).alias("tp"), F.sum(F.greatest(F.col("s") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("s"), F.lit(0))).alias("fn"))


def without_overlaps(spans: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Greedy choice of spans (doc_id, start, end, type) of each text: by start, the longer, then priority of type;
    a span that begins before the end of the last chosen one is dropped. A fold over one text's spans."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("type"))
    item = F.struct(F.col("start"), (-F.col("end")).alias("minus"), rank.alias("rank"), F.col("end"), F.col("type"))
    by = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    step = lambda a, s: F.when(s["start"] >= F.coalesce(F.element_at(a, -1)["end"], F.lit(-1)), F.concat(a, F.array(s))).otherwise(a)
    kept = F.aggregate("s", F.slice(F.col("s"), 1, 0), lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))
    return by.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.end", "s.type")


def placeholders(spans: DataFrame) -> DataFrame:
    """(doc_id, type, value, label): equal values of a text share a label TYPE_n, numbered by first occurrence."""
    first = spans.groupBy("doc_id", "type", "value").agg(F.min("start").alias("start"))
    n = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("start"))
    return first.select("doc_id", "type", "value", F.concat_ws("_", "type", n).alias("label"))
