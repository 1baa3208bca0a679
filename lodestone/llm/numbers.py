"""Words of Arrow batches as numbers: hashes of words and of runs of words, without a Python object a word.

Hashes are polynomials modulo the prime 2^61 - 1 at points drawn once for each seed, so two unlike words of n
bytes, or runs of n words, share one with chance n / 2^61 at most, whatever the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = U64((1 << 61) - 1)
#: Bytes of a word taken at a time: less than the prime whatever they hold.
STEP = 7

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = bytes.maketrans(bytes(range(0x09, 0x0E)), b" " * 5)


@lru_cache(16)
def _points(seed: int, n: int) -> tuple[np.uint64, ...]:
    return tuple(U64(x) for x in np.random.default_rng([seed, 0x10DE]).integers(1 << 40, (1 << 61) - 2, n, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.minimum(x, x - PRIME)  # below the prime the difference wraps round


def _step(a: np.ndarray, b: np.uint64, c: np.ndarray) -> np.ndarray:
    """a * b + c modulo the prime, of numbers below it, by halves of 31 bits and in pieces that stay in the cache."""
    out = np.empty(len(a), U64)
    b1, b0, low = b >> U64(31), b & U64((1 << 31) - 1), U64((1 << 31) - 1)
    for i in range(0, len(a), 1 << 14):
        x = a[i : i + (1 << 14)]
        x1, x0 = x >> U64(31), x & low
        middle = x0 * b1 + x1 * b0
        x1 *= b1 << U64(1)
        x1 += middle >> U64(30)
        middle &= U64((1 << 30) - 1)
        middle <<= U64(31)
        x0 *= b0
        x1 += middle
        x1 = (x1 & PRIME) + (x1 >> U64(61))
        out[i : i + len(x)] = _reduced(x1 + x0 + c[i : i + len(x)])
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) > 1 else np.zeros(0, np.uint8)
    return raw, at - at[0]


def parts(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for b in batches:
        _, at = _bytes_of(b.column("text"))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts: where each begins and ends among the bytes, and the index of each text's first word, with the end."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, at = _bytes_of(texts)
        space = _SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        begin, end = ~space, ~space
        begin[1:] &= space[:-1] | edge[1:-1]
        end[:-1] &= space[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, at)

    def hashes(self, seed: int = 11) -> np.ndarray:
        """The hash of each word: its bytes, STEP at a time, and its length are the coefficients."""
        (point,) = _points(seed, 1)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
        masks = np.array([(1 << 8 * k) - 1 for k in range(STEP + 1)], U64)
        length = self.end - self.begin
        out, at, left, live = length.astype(U64), self.begin, length, None
        while len(at):
            piece = eight[at] & masks[np.minimum(left, STEP)]
            if live is None:
                out = _step(out, point, piece)
            else:
                out[live] = _step(out[live], point, piece)
            more = np.flatnonzero(left > STEP)
            live = more if live is None else live[more]
            at, left = at[more] + STEP, left[more] - STEP
        return out

    def windows(self, starts: np.ndarray, size: int) -> Iterator[bytes]:
        """For each of ``starts`` the bytes of ``size`` words from there, one space between two."""
        text, upto = self.data.tobytes().translate(_BLANK), np.concatenate([[0], np.cumsum(self.end - self.begin)])
        a, b = self.begin[starts], self.end[starts + size - 1]
        plain = b - a == upto[starts + size] - upto[starts] + size - 1
        for i, j, whole in zip(a.tolist(), b.tolist(), plain.tolist()):
            yield text[i:j] if whole else b" ".join(text[i:j].split())


def hash_words(texts: pa.Array, seeds: tuple[int, ...] = (11,)) -> tuple[list[np.ndarray], np.ndarray]:
    """For each seed the hashes of all words, and the index of each text's first word, with the end."""
    w = Words(texts)
    return [w.hashes(s) for s in seeds], w.first


def runs(h: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Hashes of each k consecutive words, by doubling, with a point for each step; across texts too, which ``inside`` tells."""
    points = _points(seed, 64)
    out, width, block, w, step = None, 0, h, 1, 0
    while True:
        if k & 1:
            if out is None:
                out, width = block, w
            else:
                n = max(len(h) - width - w + 1, 0)
                out, width = _step(out[:n], points[2 * step + 1], block[width : width + n]), width + w
        k >>= 1
        if not k:
            return mix(out)
        n = max(len(h) - 2 * w + 1, 0)
        block = _step(block[:n], points[2 * step], block[w : w + n])
        w, step = 2 * w, step + 1


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one text; as long as ``runs`` is."""
    n = max(int(first[-1]) - k + 1, 0)
    return np.repeat(first[1:], np.diff(first))[:n] >= np.arange(n) + k
