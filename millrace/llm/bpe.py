"""Operator 10: BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A merge list has a *sufficient lookahead* L: tokens of BPE(u) that end L symbols before the end
of u are also tokens of BPE(uv) for every v. `lookahead()` computes it from the merges alone. Let the
frontier be the last place up to which the segmentations of u and of uv agree. Applying rule k = (a, b)
can only move it left by |a|, and only if the first piece behind it, in one of the two segmentations,
is b; if an earlier rule moved it last, that piece begins with that rule's left side. So the frontier
moves along a chain of rules of rising rank in which each left side is a prefix of the next right side,
and L is the greatest total of left sides over such chains, plus one for the last symbol, which carries
the word end. The transducer keeps at most L plus one window of symbols, emits what is stable and
starts anew behind it (any run of tokens of a BPE segmentation is the segmentation of its own text).

The transducer keeps, for each place p of what it holds, the last token of the segmentation of the first p symbols:
the only token that ends there and is *valid* behind the last token of what is before it (BPE of the two joined
gives just these two). A segmentation all of whose neighbours are valid is the BPE segmentation, so this needs no
backtracking. Whatever comes next, the token that crosses the end of what is held starts at a place behind which
some token's beginning stands; the tokens that the segmentations up to all these places have in common are stable
and go out at once. By the bound above that leaves at most L symbols, so memory is constant.

Every text is read by an `Encoder` in slices of SLICE characters; white space ends a word, so finished words go
through a transducer at once, and unfinished ones stay open. Many texts are read in step, and what a word gave is
remembered for its next occurrence.

Decoding is an incremental machine: ids go in, text comes out as soon as it is certain.

Edge cases: null or empty text gives no tokens and the hash of the empty string; rows, ties and repeated
rows are independent of each other; columns other than doc_id and text, of whatever names, are not read; an empty
table gives no rows; a very long text needs its own size and that of a slice.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import coded, gathered, memo, model

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMO, PAIRS = 96 << 20, 200_000  #: bytes of a worker's memo of words, and pairs of tokens that it remembers
SLICE = 1 << 16  #: characters of a text that are fed at a time
GROUP = 1 << 21  #: characters of all texts that are read in step
HELD = 256  #: symbols from which a transducer looks for stable tokens
OPEN = 1 << 14  #: characters without white space from which a word is streamed symbol by symbol
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
OTHER = regex.compile(r"[^\s\p{L}\p{N}]+")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return out


class Merges:
    """Vocabulary, merge ranks and the segmentation that they define. Words are tuples of symbols' strings."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {tuple(m): k for k, m in reversed(list(enumerate(merges)))}
        self.longest = max((self.symbols(t) for t in vocab), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: of each token that is its own segmentation: rank of its last merge (-1: a symbol) and the two parts
        self.made: dict[str, tuple[int, str, str]] = {}
        for t in vocab:
            pieces = self.split(t)
            if len(pieces) == 1:
                self.made[t] = -1, "", ""
            elif self.apply(pieces, 2) and len(last := self.apply(pieces, 2)) == 2 and tuple(last) in self.ranks:
                self.made[t] = self.ranks[tuple(last)], *last
        #: tokens within a word; ends of tokens that end a word, each with whether it is all of one; beginnings of both
        self.inner = ahocorasick.Automaton()
        self.finals: dict[str, bool] = {}
        self.starts: set[str] = {""}
        for t in self.made:
            final = bool(suffix) and t.endswith(suffix)
            body = t[: -len(suffix)] if final else t
            self.starts.update(body[:k] for k in range(1, len(body) + 1))
            if final:
                for k in range(1, len(body)):
                    self.finals.setdefault(body[k:], False)
                self.finals[body] = True
            else:
                self.inner.add_word(body, body)
        self.inner.make_automaton()
        self.lookahead = self._lookahead()

    def symbols(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def split(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix]
        return list(token)

    def apply(self, pieces: list[str], least: int = 1) -> list[str]:
        """The definition: the pair of least rank, leftmost first, is merged until none (or `least` pieces) is left."""
        pieces = list(pieces)
        while len(pieces) > least:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(pieces, pieces[1:])))
            if rank == 1 << 60:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def _lookahead(self) -> int:
        best: dict[str, int] = {}
        longest = 0
        for a, b in sorted(self.ranks, key=self.ranks.get):
            chain = len(a) + max([0, *(best.get(b[:k], 0) for k in range(1, len(b) + 1))])
            longest = max(longest, chain)
            if chain > best.get(a, 0):
                best[a] = chain
        return longest + 1

    def pair(self, a: str, b: str) -> bool:
        """Whether a and b can stand side by side in a segmentation.

        They can't if, at some time while they were built, the piece at the end of a and the piece at the
        start of b would have merged first. The merges are undone from the latest on: of equal rank, what
        lies further left came first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            x, y, before = a, b, 1 << 60
            while (found := self.ranks.get((x, y), 1 << 60) >= before):
                (p, _, right), (q, left, _) = self.made[x], self.made[y]
                if p < 0 and q < 0:
                    break
                if p > q:
                    x, before = right, p
                else:
                    y, before = left, q + 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def segment(self, word: str) -> list[str]:
        """Tokens of a whole word of the byte alphabet."""
        t = WordTransducer(self)
        return t.feed(word) + t.finish()


class WordTransducer:
    """Streams one word: symbols go in, tokens come out once they are stable. Holds O(lookahead) symbols."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, ""
        self.last = [""]  #: of each place: the last token of the segmentation of what is held up to there

    def _advance(self, stop: int) -> None:
        """Finds the last tokens of all places up to stop: one token that ends there fits, the others don't."""
        held, last, m = self.held, self.last, self.merges
        pairs, pair, n = m.pairs, m.pair, len(self.last)
        if stop < n:
            return
        for end, t in m.inner.iter(held, max(0, n - m.longest), stop):
            if end + 1 != n:
                if end >= n:
                    break  # nothing fitted at n
                continue
            at = n - len(t)
            if at:
                before = last[at]
                found = pairs.get((before, t))
                if not (pair(before, t) if found is None else found):
                    continue
            last.append(t)
            n += 1
        if n <= stop:
            raise ValueError(f"no token of the vocabulary fits at the end of {held[:n]!r}")

    def _back(self, place: int) -> list[str]:
        """The segmentation of what is held up to a place, last token first."""
        out = []
        while place:
            out.append(self.last[place])
            place -= len(out[-1])
        return out

    def feed(self, symbols: str) -> list[str]:
        """Takes symbols; tokens that have become stable."""
        out: list[str] = []
        for k in range(0, len(symbols), HELD):
            self.held += symbols[k : k + HELD]
            if len(self.held) > HELD:
                out += self._stable()
        return out

    def _stable(self) -> list[str]:
        """Takes out the tokens that no continuation can change."""
        n = len(self.held)
        self._advance(n)
        common: list[str] | None = None
        for p in range(max(0, n - self.merges.longest), n + 1):
            if self.held[p:] in self.merges.starts:  # a token could begin here and cross the end
                tokens = self._back(p)[::-1]
                if common is None:
                    common = tokens
                else:
                    same = next((k for k, (a, b) in enumerate(zip(common, tokens)) if a != b), min(len(common), len(tokens)))
                    common = common[:same]
        done = sum(map(len, common or []))
        self.held, self.last = self.held[done:], self.last[done:]
        return common or []

    def finish(self) -> list[str]:
        """The rest, the end of the word being known."""
        held, m, n = self.held, self.merges, len(self.held)
        out: list[str] = []
        if n and held + m.suffix in m.made:
            out = [held + m.suffix]
        elif n and not m.suffix:
            self._advance(n)
            out = self._back(n)[::-1]
        elif n:
            self._advance(n - 1)
            for p in range(n - 1, -1, -1):
                is_token = m.finals.get(held[p:])
                if is_token is None:
                    raise ValueError(f"no token of the vocabulary ends the word {held!r}")
                if is_token and (not p or m.pair(self.last[p], held[p:] + m.suffix)):
                    out = [*self._back(p)[::-1], held[p:] + m.suffix]
                    break
        self.held, self.last = "", [""]
        return out


class Codec:
    """One tokenizer file: normaliser, pre-tokenizer, merges, decoder. Only the kinds named in SUPPORTED."""

    SUPPORTED = "NFC, white space to one space, lower case; a Split pattern whose matches stay; byte level; BPE"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec.get("decoder"):
            raise ValueError(f"{path}: supported are: {self.SUPPORTED}")
        model = spec["model"]
        self.merges = Merges(model["vocab"], (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]), model.get("end_of_word_suffix") or "")
        self.ids = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids |= self.special
        self.text = {i: t for t, i in self.ids.items()}
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.table = "".join(self.alphabet[b] for b in range(256))
        self.name = f"cells of {path}"
        top = max(self.text, default=-1) + 1
        self.number = [str(i) for i in range(top)]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to the word's end
        return text.lower()

    def symbols(self, text: str) -> str:
        """The byte alphabet's characters; printable ASCII stands for itself."""
        return text if text.isascii() and text.isprintable() and " " not in text else text.encode().decode("latin-1").translate(self.table)

    def word(self, text: str) -> list[str]:
        return self.merges.segment(self.symbols(text))

    def parts(self, cell: str) -> list[str]:
        """Pre-tokens and special strings of a run of text that has no white space within."""
        if cell.isascii() and cell.isalpha():
            return [cell.lower()]
        out: list[str] = []
        for k, part in enumerate(self.marks.split(cell) if self.marks and "<" in cell else [cell]):
            if k % 2:
                out.append(part)
            elif part:
                out += self.pattern.findall(self.normal(part))
        return out

    def raw(self, cells: list[str]) -> list[bytes]:
        """Ids of each cell as little-endian unsigned 32-bit integers; words are remembered besides the cells."""
        parts = [self.parts(cell) for cell in cells]
        words = list({w for p in parts for w in p})
        known = dict(zip(words, memo(self.name, MEMO).values(["\n" + w for w in words], self.raw_words)))
        return [known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p]) for p in parts]

    def raw_words(self, words: list[str]) -> list[bytes]:
        ids, special = self.ids, self.special
        return [array("I", [ids[w[1:]]] if w[1:] in special else [ids[t] for t in self.word(w[1:])]).tobytes() for w in words]

    def encode(self, lists: list[list[str | bytes]]) -> list[np.ndarray]:
        """Ids of lists of cells; what is bytes are ids already."""
        kept = memo(self.name, MEMO)
        cells, at, size = coded([[x for x in items if isinstance(x, str)] for items in lists])
        values = kept.values(cells, self.raw)
        flat, n = gathered(values, at, size)
        cut = np.r_[0, np.cumsum(n)]
        out = [flat[i:j] for i, j in zip(cut[:-1], cut[1:])]
        for k, items in enumerate(lists):
            if any(isinstance(x, bytes) for x in items):
                value = dict(zip(cells, values))
                out[k] = np.frombuffer(b"".join([x if isinstance(x, bytes) else value[x] for x in items]), "<u4")
        return out

    def split(self, text: str) -> list[str]:
        return [x for x in SPACE.split(text) if x] if ODD_SPACE.search(text) else text.split()


class Encoder:
    """Streams one text: feed() it in slices of any size, then finish().

    Out come finished cells, and ids of words that are still open as they become stable. Holds at most one slice, OPEN
    characters and the transducer's, however long the text.
    """

    def __init__(self, codec: Codec):
        self.codec, self.rest, self.open, self.kind = codec, "", None, ""
        self.hold = max([3, *map(len, codec.special)])

    def feed(self, piece: str) -> list[str | bytes]:
        self.rest += piece
        out: list[str | bytes] = []
        cut = next((k for k in range(len(self.rest), 0, -1) if SPACE.match(self.rest[k - 1])), 0)
        if cut:
            head, self.rest = self.rest[:cut], self.rest[cut:]
            if self.open:  # the first word goes on with the one that is open
                first = SPACE.search(head)
                out += self._ids(self._close(head[: first.start()]))
                head = head[first.end() :]
            out += self.codec.split(head)
        while len(self.rest) > OPEN:
            done = self._cut(self.rest[: OPEN - self.hold])
            if not done:
                break
            head, self.rest = self.rest[:done], self.rest[done:]
            out += self._ids(self._stream(head))
        return out

    def _ids(self, tokens: Iterable[str]) -> list[bytes]:
        return [np.array([self.codec.ids[t] for t in tokens], "<u4").tobytes()]

    def _cut(self, text: str) -> int:
        """A place before which nothing can change: no special string, contraction or composition spans it."""
        for at in range(len(text) - 1, len(text) // 2, -1):
            a, b = text[at - 1], text[at]
            if "'" in text[at - 3 : at] or any(s[:k] == text[at - k : at] for s in self.codec.special for k in range(1, min(len(s), at) + 1)):
                continue
            if not unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b):
                return at
        return 0

    def _stream(self, text: str) -> Iterator[str]:
        """Part of a word without white space; its last run stays open."""
        parts = self.codec.marks.split(text) if self.codec.marks else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield from self._end()
                yield part
                continue
            part = self.codec.normal(part)
            if self.open and self.kind == "other" and (run := OTHER.match(part)):  # the open run takes all that it can
                yield from self.open.feed(self.codec.symbols(run[0]))
                part = part[run.end() :]
            for w in self.codec.pattern.findall(part):
                kind = "letters" if w[0].isalpha() or regex.match(r"\p{L}", w) else "single" if regex.match(r"\p{N}", w) else "other"
                if w[0] == "'" and len(w) > 1 and w[1].isalpha():
                    kind = "single"
                if kind != self.kind or kind == "single":
                    yield from self._end()
                    self.kind, self.open = kind, WordTransducer(self.codec.merges)
                yield from self.open.feed(self.codec.symbols(w))

    def _end(self) -> Iterator[str]:
        if self.open:
            yield from self.open.finish()
        self.open, self.kind = None, ""

    def _close(self, text: str) -> Iterator[str]:
        yield from self._stream(text)
        yield from self._end()

    def finish(self) -> list[str | bytes]:
        rest, self.rest = self.rest, ""
        return self._ids(self._close(rest)) if self.open else self.codec.split(rest)


class Decoder:
    """Ids to text, incrementally.

    joined (as a tokenizer file without a decoder does it): tokens as they are written, a space between.
    bytes: each token's bytes through a UTF-8 state machine that holds an unfinished character back;
    a word end becomes a space and malformed bytes become U+FFFD.
    """

    def __init__(self, codec: Codec, mode: str = "joined"):
        if mode not in ("joined", "bytes"):
            raise ValueError(f"no such mode: {mode}")
        self.codec, self.mode, self.first = codec, mode, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.of = {c: b for b, c in codec.alphabet.items()}

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "joined":
            tokens = [t for t in map(self.codec.text.get, ids) if t is not None]  # the library skips unknown ids
            text = " ".join(tokens) if self.first or not tokens else " " + " ".join(tokens)
            self.first = self.first and not tokens
            return text
        out = []
        for i in ids:
            token = self.codec.text.get(i)
            if token is None:
                continue  # as the library does with ids that it doesn't know
            if token in self.codec.special:
                out.append(self.machine.decode(b"", True) + token)
                self.machine.reset()
            else:
                end = self.codec.merges.suffix
                body = token[: -len(end)] if end and token.endswith(end) else token
                out.append(self.machine.decode(bytes(self.of[c] for c in body)) + " " * (body != token))
        return "".join(out)

    def finish(self) -> str:
        return self.machine.decode(b"", True) if self.mode == "bytes" else ""


def codec(path: str | None = None) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return model(f"codec {path}", lambda: Codec(path))


def streamed(texts: list[str | None], c: Codec) -> Iterator[list[tuple[int, np.ndarray, bool]]]:
    """Reads the texts slice by slice, each by an Encoder of its own; rounds of (text's place, its next ids, whether they are its last)."""
    at = 0
    while at < len(texts):
        lanes, held = [], 0
        while at < len(texts) and (not lanes or held < GROUP):
            text = texts[at] or ""
            lanes.append((at, text, Encoder(c)))
            held += min(len(text), SLICE)
            at += 1
        begin = 0
        while lanes:
            last = [begin + SLICE >= len(text) for _, text, _ in lanes]
            items = [e.feed(text[begin : begin + SLICE]) + (e.finish() if end else []) for (_, text, e), end in zip(lanes, last)]
            yield [(k, ids, end) for (k, _, _), ids, end in zip(lanes, c.encode(items), last)]
            lanes = [x for x, end in zip(lanes, last) if not end]
            begin += SLICE


def encode_ids(text: str | None, c: Codec) -> list[int]:
    """All ids of one text."""
    return [i for found in streamed([text], c) for _, ids, _ in found for i in ids.tolist()]


class Digest:
    """Takes a text's ids as they come; number of tokens, SHA-256 of the ids joined by a space, SHA-256 of the decoded text."""

    def __init__(self, c: Codec):
        self.codec, self.n, self.decoder = c, 0, Decoder(c)
        self.ids, self.decoded = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: list[int]) -> None:
        if ids:
            self.ids.update((" " * (self.n > 0) + " ".join(map(self.codec.number.__getitem__, ids))).encode())
        self.n += len(ids)
        self.decoded.update(self.decoder.feed(ids).encode())

    def result(self) -> tuple[int, str, str]:
        self.decoded.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def digest_all(texts: list[str | None], c: Codec) -> list[tuple[int, str, str]]:
    """A Digest's result for each text."""
    out: list = [None] * len(texts)
    open_: dict[int, Digest] = {}
    for found in streamed(texts, c):
        for k, ids, end in found:
            d = open_.get(k) or open_.setdefault(k, Digest(c))
            d.take(ids.tolist())
            if end:
                out[k] = open_.pop(k).result()
    return out


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: one pass, no shuffle, bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = digest_all(b.column(1).to_pylist(), c)
            n, i, d = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def bpe_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids, for use by other jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([encode_ids(t.as_py(), c) for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
