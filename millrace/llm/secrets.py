"""Operator 8: secret scan.

Base kinds are patterns: assign (a value given to a password-like name), access (access key ids), hex (long
runs of hexadecimal digits). The token-efficiency test adds kind `random`: of a run of 20 or more characters of
A-Z a-z 0-9 + / = _ - what takes so many tokens of a tiktoken vocabulary that a token covers fewer than 2
characters on average. Written language and identifiers are covered by long tokens; random strings are not. The
test takes what base spans leave of a run, first as a whole, then of each 20 characters or more of pieces between
/ _ - in a row that aren't words, so ordinary words beside a key don't hide it. A word is up to 4 digits, or
letters with up to 4 digits behind them that are fewer than 8 or efficient in tokens. Left out are known digests
(hexadecimal of 32, 40, 56, 64, 96 or 128 digits, UUIDs), runs of words and of digits.

Offsets are code points, ends exclusive. Edge cases: null and empty texts have no spans; rows are independent, repeated
ones come out repeated; an empty table gives no rows; columns other than doc_id and text, of whatever names, are not read
(redact() keeps them all); a very long text needs a few times its own size, and its time grows in proportion.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import model

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO = 20, 2.0
RUN = re.compile(rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{{{LEAST},}}=*")
DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})=*")
PIECE = re.compile(r"[^/_-]+")
WORD = re.compile(r"([A-Za-z]*)[0-9]{0,4}=*")
NUMBERS = re.compile(r"[0-9+/_=-]+")
SHORT = 8  #: letters from which a word is tested
Span = tuple[int, int, int]


def vocabulary(path: str):
    def make():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return model(f"vocabulary {path}", make)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, sorted."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(i: int, j: int, base: list[Span], upto: list[int]) -> list[tuple[int, int]]:
    """What base spans leave of i..j. upto: of each span the greatest end of those up to it, which is ascending."""
    out = []
    for start, _, end in base[bisect.bisect_right(upto, i) :]:
        if start >= j:
            break
        if end > i:
            out.append((i, start))
            i = max(i, end)
    return [(a, b) for a, b in [*out, (i, j)] if a < b]


def random_spans(text: str, base: list[Span], encoding, ratio: float = RATIO) -> list[Span]:
    upto = list(itertools.accumulate((end for _, _, end in base), max))

    def dense(s: str) -> bool:
        return len(s) < ratio * len(encoding.encode_ordinary(s))

    def word(s: str) -> bool:
        m = WORD.fullmatch(s)
        return bool(m) and (len(m[1]) < SHORT or not dense(m[1]))

    def rest(i: int, j: int) -> list[tuple[int, int]]:
        """What base spans leave of i..j, if it is random."""
        left = outside(i, j, base, upto)
        s = "".join([text[a:b] for a, b in left])
        random = j - i >= LEAST and not DIGEST.fullmatch(s) and not NUMBERS.fullmatch(s) and dense(s)
        return left if random else []

    out: list[Span] = []
    for m in RUN.finditer(text):
        if DIGEST.fullmatch(m[0]) or NUMBERS.fullmatch(m[0]):
            continue
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m[0])]
        left = [outside(i, j, base, upto) for i, j in pieces]
        strange = [any(not word(text[a:b]) for a, b in x) for x in left]
        if not any(strange):
            continue
        found = rest(*m.span())
        if not found:
            first = last = None
            for (i, j), x, is_strange in [*zip(pieces, left, strange), ((0, 0), [(0, 0)], False)]:
                if is_strange:
                    first, last = i if first is None else first, j
                elif x and first is not None:  # a piece that lies within base spans ends nothing
                    found += rest(first, last)
                    first = None
        out += [(a, 3, b) for a, b in found]
    return out


def find(text: str | None, encoding, ratio: float = RATIO) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encoding, ratio))


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{i}:{j}" for i, k, j in spans])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of spans that overlap, replaced by its first kind in brackets."""
    out, at = [], 0
    for i, k, j in spans:
        if i >= at:
            out += [text[at:i], f"[{KINDS[k]}]"]
        at = max(at, j)
    return "".join([*out, text[at:]])


def path_of(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def scan(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """Counts and spans of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path_of(path))
        for b in batches:
            found = [find(t.as_py(), encoding, ratio) for t in b.column(1)]
            counts = [pa.array([sum(k == n for _, k, _ in every) for _, every in found], pa.int64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    *counts,
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([written(every) for _, every in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs with the secrets in column text replaced; other columns, and texts without secrets, stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path_of(path))
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t and redacted(t, find(t, encoding, ratio)[1]) for t in texts]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
