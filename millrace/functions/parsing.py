"""Parsing that column expressions can't express, as plain functions and as Arrow-batched UDFs around them."""

from __future__ import annotations

import ast
import base64
import json
import re
from bisect import bisect_right
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what stands in a word's place
ABBREVIATIONS = frozenset({"e.g", "i.e", "etc", "vs", "approx"})
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
FENCE = re.compile(r"```[A-Za-z0-9_-]*[ \t]*\n?(.*?)```", re.S)
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])|.', re.S)
MARK = re.compile(r"⟦([^⟦⟧]*)⟧")
TERMINATORS, CLOSERS, OPENERS = ".!?", "\"')]”’", "\"'([“‘"


def normalized(text: str | None) -> str:
    """NFKC, case folded, runs of white space made one blank."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def visible(text: str | None) -> str:
    """NFKC without zero-width characters, lower case."""
    return unicodedata.normalize("NFKC", text or "").translate(INVISIBLE).lower()


def joined_letters(text: str, least: int = 4) -> str:
    """Runs of `least` or more single characters between blanks are made one word."""
    return re.sub(rf"(?<!\S)\S(?: \S){{{least - 1},}}(?!\S)", lambda m: m[0].replace(" ", ""), text)


def as_object(text: str):
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def fenced(text: str) -> str:
    """Content of the first code fence; the text itself without one."""
    m = FENCE.search(text)
    return m[1].strip() if m else text


def balanced(text: str) -> str:
    """The first object whose braces balance, strings apart."""
    start = text.find("{")
    depth, quoted, i = 0, False, start
    while 0 <= i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    raise ValueError("no balanced object")


def without_trailing_commas(text: str) -> str:
    return "".join("" if m[0] == "," and m.end() < len(text) and text[m.end() :].lstrip()[:1] in "}]" else m[0] for m in TOKENS.finditer(text))


def literal(text: str) -> dict:
    value = ast.literal_eval(text)
    if not isinstance(value, dict):
        raise ValueError("not a dict")
    return value


LAYERS: tuple[tuple[str, Callable[[str], dict]], ...] = (
    ("strict", as_object),
    ("fence", lambda t: as_object(fenced(t))),
    ("extract", lambda t: as_object(balanced(fenced(t)))),
    ("commas", lambda t: as_object(without_trailing_commas(balanced(fenced(t))))),
    ("literal", lambda t: literal(balanced(fenced(t)))),
)


def lenient(text: str | None) -> tuple[str | None, dict | None]:
    """Name of the first layer that reads an object, and the object."""
    for name, read in LAYERS:
        try:
            return name, read(text or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None, None


def marked(text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """Text without its ⟦TYPE⟧…⟦/⟧ marks, and the spans (start, end, type, value) that they enclosed."""
    out, spans, open_, at = "", [], None, 0
    for m in MARK.finditer(text):
        out += text[at : m.start()]
        at = m.end()
        if m[1] == "/":
            if open_ is None:
                raise ValueError("a mark is closed that isn't open")
            spans.append((open_[0], len(out), open_[1], out[open_[0] :]))
            open_ = None
        elif open_ is not None or not m[1]:
            raise ValueError("a mark within a mark, or without a type")
        else:
            open_ = (len(out), m[1])
    out += text[at:]
    if open_ is not None or "⟦" in out or "⟧" in out:
        raise ValueError("a mark isn't closed")
    return out, spans


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of sentences: they end behind terminators and closing signs where white space and then a capital or digit
    follow, unless the word before is an abbreviation."""
    text = text or ""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] not in TERMINATORS:
            i += 1
            continue
        end = i
        while end < len(text) and text[end] in TERMINATORS + CLOSERS:
            end += 1
        after = end
        while after < len(text) and text[after].isspace():
            after += 1
        first = text[after : after + 2].lstrip(OPENERS)[:1]
        word = re.search(r"(\S+)$", text[start:i])
        if after == len(text) or (after > end and (first.isupper() or first.isdigit()) and not (word and word[1].lower().strip(OPENERS) in ABBREVIATIONS)):
            out.append((start, end))
            start = after
        i = max(after if after > end else end, i + 1)
    if text[start:].strip():
        out.append((start, start + len(text[start:].rstrip())))
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in out if text[a:b].strip()]


def sentence_chunks(text: str | None, budget: int) -> list[tuple[int, int]]:
    """Whole sentences packed in order under a budget of words; a longer sentence is a chunk of its own.

    Sums of words up to each sentence tell, for each first sentence, the last one that still fits."""
    text = text or ""
    spans = sentences(text)
    upto = list(accumulate((len(text[a:b].split()) for a, b in spans), initial=0))
    out, first = [], 0
    while first < len(spans):
        last = max(first + 1, bisect_right(upto, upto[first] + budget) - 1)
        out.append((spans[first][0], spans[last - 1][1]))
        first = last
    return out


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON of the value) of each leaf; empty containers are leaves."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in leaves(value[k], f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    return [(path, json.dumps(value, sort_keys=True))]


def generic(path: str) -> str:
    """A path with [] for each index."""
    return re.sub(r"\[\d+\]", "[]", path)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hidden_base64(text: str | None, least: int = 24) -> list[str]:
    """Texts that base64 runs of a text decode to: twelve bytes or more, nine tenths of them printable."""
    out = []
    for m in re.finditer(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}", text or ""):
        try:
            raw = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4), validate=True).decode()
        except ValueError:
            continue
        if len(raw) >= 12 and sum(c.isprintable() or c in "\n\t" for c in raw) >= 0.9 * len(raw):
            out.append(raw)
    return out


def udf(f: Callable, returns: str) -> Callable[[Column], Column]:
    """f as an Arrow-batched column function, made when it is first used."""

    def column(c: Column) -> Column:
        @F.pandas_udf(returns)
        def run(x: pd.Series) -> pd.Series:
            return x.map(f)

        return run(c)

    return column


normalize = udf(normalized, "string")
sentence_spans = udf(lambda t: [{"start": a, "end": b} for a, b in sentences(t)], "array<struct<start:int,end:int>>")
json_leaves = udf(lambda t: [{"path": p, "value": v} for p, v in leaves(json.loads(t))] if t else [], "array<struct<path:string,value:string>>")
