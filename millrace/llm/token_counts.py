"""Operator 7: token counts by overlap resynchronisation.

Every text is read as chunks of `chunk` characters, each of which runs on over the first `overlap` characters of
the next; the library encodes each chunk, with offsets. A chunk begins in the middle of anything, so its first
tokens may be wrong, and so may the last ones of the chunk before. Two chunks are spliced at a *proven stable
common boundary* in their overlap: a blank between two letters or digits, at which a token begins in both. Whatever
stands further left or right, a pre-token of the byte-level pattern begins there: no pre-token that holds a letter
or digit takes in a blank behind it, special strings hold no blank, and merges don't cross pre-tokens. So the first
chunk's tokens before it and the second's from it on are those of the whole text; as a further test the tokens from
there up to the next such place have to be the same in both. Where an overlap has no such boundary, or the tokens
don't agree, it is widened to twice its size, again and again, until the second chunk is swallowed whole; so a text
without blanks becomes one chunk. A text that ends within its first chunk is the case without splices.

Edge cases: null and empty texts have no tokens; ties, repeated rows and other columns, of whatever names, change
nothing; an empty table gives no rows; a very long text needs its own size and that of one group of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import model
from .library import place, tokenizer_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CHUNK, OVERLAP = 1024, 64
GROUP = 1 << 20  #: characters that the library gets at once
BOUNDARY = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def tokenizer(path: str):
    return model(f"tokenizer {path}", lambda: tokenizer_of(path))


@dataclass
class Chunk:
    start: int  #: where its text begins
    end: int
    first: int  #: the boundary from which its tokens count
    last: int  #: and up to which


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks of a text that overlap around a boundary each."""
    out, start, first = [], 0, 0
    while True:
        cut, wide = start + chunk, overlap
        found = None
        while cut + wide < len(text):
            found = BOUNDARY.search(text, cut + 1, cut + wide - 1)
            if found or wide >= chunk:
                break
            wide *= 2
        while not found and cut + wide < len(text):  # all of the next chunk is swallowed, and so on
            wide += chunk
            found = BOUNDARY.search(text, cut + wide - chunk - 1, min(len(text), cut + wide) - 1)
        if not found:
            return [*out, Chunk(start, len(text), first, len(text))]
        p = found.start()
        out.append(Chunk(start, min(len(text), cut + wide), first, p))
        start, first = min(cut, p - 1) if p - cut < chunk else p - 1, p


def token_at(encoding, place: int) -> int | None:
    """Number of the token that begins at a place of the encoded text, None if none does."""
    k = encoding.char_to_token(place)
    return k if k is not None and encoding.token_to_chars(k)[0] == place else None


def spliced(text: str, parts: list[Chunk], encodings: list) -> int | None:
    """The number of tokens of a text from its chunks' encodings; None if two chunks don't agree at their boundary."""
    total = 0
    for k, (c, e) in enumerate(zip(parts, encodings)):
        low = token_at(e, c.first - c.start) if k else 0
        high = token_at(e, c.last - c.start) if k + 1 < len(parts) else len(e)
        if low is None or high is None:
            return None
        total += high - low
        if k + 1 < len(parts):
            after = parts[k + 1]
            again = BOUNDARY.search(text, c.last + 1, min(c.end, after.end) - 1)
            if again:  # both chunks read what stands between two boundaries
                there = [token_at(e, p - c.start) for p in (c.last, again.start())]
                here = [token_at(encodings[k + 1], p - after.start) for p in (c.last, again.start())]
                if None in there or None in here or there[1] - there[0] != here[1] - here[0]:
                    return None
    return total


def counted(texts: list[str | None], t, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Number of tokens of each text."""
    out: list[int] = []
    at = 0
    while at < len(texts):
        held, plans = 0, []
        while at + len(plans) < len(texts) and (not plans or held < GROUP):
            text = texts[at + len(plans)] or ""
            plans.append(chunks(text, chunk, overlap))
            held += len(text)
        group = [x or "" for x in texts[at : at + len(plans)]]
        pieces = [x[c.start : c.end] for x, p in zip(group, plans) for c in p]
        found: list = []
        for k in range(0, len(pieces), 4 * GROUP // chunk):
            found += t.encode_batch(pieces[k : k + 4 * GROUP // chunk], add_special_tokens=False)
        first = 0
        for text, plan in zip(group, plans):
            n, wide = spliced(text, plan, found[first : first + len(plan)]), overlap
            first += len(plan)
            while n is None:  # alignment failed: wider overlaps
                wide *= 2
                plan = chunks(text, max(chunk, 2 * wide), wide) if wide < len(text) else [Chunk(0, len(text), 0, len(text))]
                n = spliced(text, plan, t.encode_batch([text[c.start : c.end] for c in plan], add_special_tokens=False))
            out.append(n)
        at += len(plans)
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by a byte-level tokenizer file; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or place("byte_bpe_50k.json"))
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counted(texts, t, chunk, overlap)
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
