"""Vectorised 64-bit hashes of words, shingles and byte windows over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_RADIX, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Prefix:
    """Polynomial hashes of any stretch of a byte array, modulo 2**64."""

    def __init__(self, raw: np.ndarray) -> None:
        size = 1 << max(16, int(len(raw) + 1).bit_length())
        self.up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * self.up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The unmixed hash of the window of that size at each position where it fits."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row (null: none), and offsets from 0."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1_500_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of at most so many bytes (or one text), with the place of each run's first."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


class Batch:
    """Texts cut into words at ASCII white space, with a hash of each word."""

    def __init__(self, texts: pa.Array, fold: bool = False) -> None:
        self.raw, self.offsets = raw_of(texts)
        if fold:
            upper = (self.raw >= 65) & (self.raw <= 90)
            self.raw = self.raw | (upper.astype(np.uint8) << 5)
        self.n = len(texts)
        word = ~_SPACE[self.raw]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], word[:-1]]) & ~edge[:-1] if len(word) else word
        after = np.concatenate([word[1:], [False]]) & ~edge[1:] if len(word) else word
        self.word_starts = np.flatnonzero(word & ~before)
        self.word_ends = np.flatnonzero(word & ~after) + 1
        self.word_cuts = np.searchsorted(self.word_starts, self.offsets)
        self.word_hashes = Prefix(self.raw).of(self.word_starts, self.word_ends)

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct shingle hashes, ascending, and n + 1 offsets into them.

        A text of fewer words has its whole sequence as one shingle; one without words has none.
        """
        h, cuts = self.word_hashes, self.word_cuts
        count = np.diff(cuts)
        total = len(h)
        factors = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            runs = np.zeros(max(0, total - size + 1), np.uint64)
            for k in range(size):
                runs += h[k : k + len(runs)] * factors[k]
            runs = mix64(runs)
            owner = np.repeat(np.arange(self.n), count)
            fits = np.arange(len(runs)) + size <= cuts[1:][owner[: len(runs)]] if len(runs) else np.zeros(0, bool)
            keys, who = runs[fits], owner[: len(runs)][fits]
            short = np.flatnonzero((count > 0) & (count < size))
            few = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = count[short] > k
                few[has] += h[cuts[short[has]] + k] * factors[k]
            few = mix64(few ^ mix64(count[short].astype(np.uint64)))
        keys, who = np.concatenate([keys, few]), np.concatenate([who, short])
        order = np.lexsort((keys, who))
        keys, who = keys[order], who[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
        keys, who = keys[new], who[new]
        return keys, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=self.n))]).astype(np.int64)
