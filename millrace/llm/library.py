"""The tokenizers library for tokenizer files that drop white space, behind a memo of words.

The ids of a text are those of its words (what lies between white space) in turn: the pre-tokenizer joins nothing
across white space. Distinct words that the memo doesn't hold go to the library many at a time, with MARK, which is
a pre-token with an id of its own, between them; the ids are cut at MARK's. Where the file's words end in a suffix, words of
Latin letters, with or without signs behind them, need no MARK: each is one pre-token or two, whose last ids have that
suffix. Texts with U+001C to U+001F or U+180E,
which Python and the library class differently, and words with MARK go to the library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import coded, gathered, memo, model

MEMO = 256 << 20  #: bytes that a worker's memo may take
MARK = "\x01"
ODD = re.compile("[\x01\x1c-\x1f᠎]")
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+([.,;:!?]+)?")  # one pre-token, or two; U+0130 has two characters in lower case
JOINED = 512  #: words that the library gets as one text


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_of(path: str):
    """The library's tokenizer of a file, without truncation, padding and threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Library:
    def __init__(self, path: str):
        self.path, self.tokenizer = path, tokenizer_of(path)
        found = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(found) != 1:
            raise ValueError(f"{path}: no id of its own for U+0001")
        self.mark = found[0]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)  #: ids that end a pre-token
        self.final[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        pieces = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("Zq", "zq.", "éÀ?!")]
        self.simple = bool(suffix) and [int(self.final[p].sum()) for p in pieces] == [1, 2, 2]

    def words(self, text: str) -> list[str]:
        return [text] if ODD.search(text) else text.split()

    def raw(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        odd = [k for k, w in enumerate(words) if ODD.search(w)]
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        skip = set(odd)
        rest, simple, n = [], [], []
        for k, w in enumerate(words):
            if k in skip:
                continue
            if self.simple and (found := SIMPLE.fullmatch(w)):
                simple.append(k)
                n.append(2 if found[1] else 1)
            else:
                rest.append(k)
        for at in range(0, len(simple), JOINED):
            part = simple[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            last, ends = np.flatnonzero(self.final[ids]), np.cumsum(n[at : at + JOINED])
            if len(last) == ends[-1]:
                self.share(out, part, ids, np.r_[0, last[ends - 1] + 1], 0)
            else:
                rest += part
        for at in range(0, len(rest), JOINED):
            part = rest[at : at + JOINED]
            text = f" {MARK} ".join([words[k] for k in part]) + f" {MARK}"
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part):
                raise ValueError("a word was cut by the library")
            self.share(out, part, ids, np.r_[0, cut + 1], 1)
        return out

    @staticmethod
    def share(out: list[bytes], part: list[int], ids: np.ndarray, cut: np.ndarray, marks: int) -> None:
        """Gives each word of part its ids: those between two cuts, without the marks at their end."""
        data, cut = ids.tobytes(), (4 * cut).tolist()
        for k, i, j in zip(part, cut, cut[1:]):
            out[k] = data[i : j - 4 * marks]

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of all texts, the place of each word among them, and the texts' numbers of words."""
        if any(map(ODD.search, texts)):
            return coded([self.words(t) for t in texts])
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))  # with empty words at the texts' ends
        flat, offsets = lists.flatten().dictionary_encode(), np.asarray(lists.offsets)
        words, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        full = np.array([bool(w) for w in words], bool)
        keep = full[at] if len(words) else np.zeros(0, bool)
        upto = np.r_[0, np.cumsum(keep)]
        return [w for w in words if w], (np.cumsum(full) - 1)[at[keep]], np.diff(upto[offsets])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        words, at, size = self.cut(texts)
        return gathered(memo(f"ids of {self.path}", MEMO).values(words, self.raw), at, size)


def library(path: str) -> Library:
    return model(f"library {path}", lambda: Library(path))
