"""MD5 of many short messages that differ in a number, as array arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np

TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 1 << 13  #: messages that are worked on together, so that they stay in a core's cache


def digest_heads(prefix: bytes, first: int, stop: int) -> np.ndarray:
    """The first eight hexadecimal digits of MD5(prefix + str(i)), as numbers, for i from first to stop - 1."""
    out = np.empty(stop - first, np.int64)
    at = first
    while at < stop:
        digits = len(str(at))
        end = min(stop, 10**digits, at + BLOCK)  # messages of one length
        if len(prefix) + digits <= 55:
            out[at - first : end - first] = _one_block(prefix, at, end, digits)
        else:
            out[at - first : end - first] = [int.from_bytes(hashlib.md5(prefix + str(i).encode()).digest()[:4], "big") for i in range(at, end)]
        at = end
    return out


def _one_block(prefix: bytes, first: int, stop: int, digits: int) -> np.ndarray:
    size = len(prefix) + digits
    fixed = bytearray(64)
    fixed[: len(prefix)] = prefix
    fixed[size] = 0x80
    fixed[56:64] = (8 * size).to_bytes(8, "little")
    words: list = [np.uint32(w) for w in np.frombuffer(bytes(fixed), "<u4")]
    i = np.arange(first, stop, dtype=np.int64)
    for k in range(digits):  # the last digit first
        place = size - 1 - k
        words[place >> 2] = words[place >> 2] + ((i % 10 + 48).astype(np.uint32) << np.uint32(8 * (place & 3)))
        i //= 10
    a, b, c, d = (np.full(stop - first, x, np.uint32) for x in START)
    for step in range(64):
        kind = step >> 4
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), step
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * step + 1) & 15
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * step + 5) & 15
        else:
            f, g = c ^ (b | ~d), (7 * step) & 15
        word = words[g] + np.uint32(SINES[step]) if isinstance(words[g], np.ndarray) else np.uint32((int(words[g]) + SINES[step]) & 0xFFFFFFFF)
        f += a
        f += word
        turn = TURNS[kind][step & 3]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return (a + np.uint32(START[0])).byteswap().astype(np.int64)
