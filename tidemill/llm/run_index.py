"""A run-length compressed Burrows-Wheeler index of many short byte strings.

The transform is kept as runs: their first rows, their symbols, how often the symbol came before, and the
text position at each run's first and last row. Matching statistics of query strings are streamed over it
from right to left: a row follows its query's bytes by LF steps, and where the byte differs it jumps to
the nearer run of that byte, the one above or below with the longer common extension. All queries step
together, so the cost is a few vector operations per byte.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_RADIX = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


def suffix_order(symbols: np.ndarray, n_ends: int, alphabet: int) -> np.ndarray:
    """The suffix array of symbols, where values below n_ends are distinct ends of strings, by doubling."""
    n, top = len(symbols), np.int64(n_ends + alphabet + 1)
    padded = np.concatenate([symbols + 1, np.zeros(2, np.int64)])
    key = (padded[:n] * top + padded[1 : n + 1]) * top + padded[2 : n + 2]
    order = np.argsort(key)
    rank, step = np.empty(n, np.int64), 3
    places, ordered, sub = np.arange(n), key[order], order
    while True:
        # Suffixes of one key form a group, ranked by its first place; groups of one are done.
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank[sub] = places[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        open_ = ~(new & np.concatenate([new[1:], [True]]))
        places, sub = places[open_], sub[open_]
        if not len(sub):
            return order
        after = sub + step
        key = rank[sub] * np.int64(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        ordered, sub = key[again], sub[again]
        order[places] = sub
        step *= 2


class RunIndex:
    def __init__(self, strings: Sequence[np.ndarray], classes: Sequence[int] | None = None) -> None:
        """strings: uint8 arrays, none of them empty; those of different classes have no byte in common."""
        kinds = np.zeros(len(strings), np.int64) if classes is None else np.asarray(classes, np.int64)
        self.end = 256 * (int(kinds.max()) + 1)
        size = np.array([len(s) for s in strings])
        n_ends = len(strings)
        self.n = int(size.sum()) + n_ends
        ends = np.cumsum(size + 1) - 1
        symbols = np.zeros(self.n, np.int64)
        body = np.ones(self.n, bool)
        body[ends] = False
        symbols[body] = np.concatenate(strings).astype(np.int64) + 256 * np.repeat(kinds, size) + n_ends
        symbols[ends] = np.arange(n_ends)
        order = suffix_order(symbols, n_ends, self.end)
        self.text = np.full(self.n, self.end, np.int64)
        self.text[body] = symbols[body] - n_ends
        bwt = self.text[order - 1]  # before position 0 stands an end
        first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        last = np.concatenate([first[1:], [self.n]]) - 1
        self.run_first, self.run_symbol = first, bwt[first]
        self.at_first, self.at_last = order[first], order[last]  # the sampled run ends
        self.run_last = last
        length = last - first + 1
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        total = np.cumsum(length[by_symbol]) - length[by_symbol]
        group = self.run_symbol[by_symbol]
        begin = np.searchsorted(group, np.arange(self.end + 2))
        base = np.concatenate([total, [self.n]])[begin]
        self.before = np.empty(len(first), np.int64)
        self.before[by_symbol] = total - base[group]
        counts = np.bincount(bwt, minlength=self.end + 1)[: self.end]
        self.starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) + n_ends  # first row of each byte's suffixes
        self.run_of = np.repeat(np.arange(len(first), dtype=np.int32), length)  # a rank directory for LF steps
        # Runs of each symbol in order, searchable by (symbol, run).
        self.keys = group * len(first) + by_symbol
        self.key_run, self.key_begin = by_symbol, begin

    def runs(self) -> int:
        return len(self.run_first)

    def pointers(self, queries: Sequence[np.ndarray], classes: Sequence[int] | None = None) -> np.ndarray:
        """For each byte of the queries in a row, a text position where the longest match of what starts there starts."""
        size = np.array([len(q) for q in queries])
        cut = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int((size + 1).sum()), self.end + 1, np.int64)
        keep = np.ones(len(flat), bool)
        keep[cut + size] = False
        flat[keep] = np.concatenate(queries) + (0 if classes is None else 256 * np.repeat(np.asarray(classes, np.int64), size))
        self._hash(flat)
        out = np.full(len(flat), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        size, cut = size[order], cut[order]
        row, at = np.zeros(len(size), np.int64), np.full(len(size), -1, np.int64)
        longest = int(size[0]) if len(size) else 0
        for step in range(longest):
            live = int(np.searchsorted(-size, -step))  # queries with more than step bytes
            place = cut[:live] + size[:live] - 1 - step
            row[:live], at[:live] = self._back(row[:live], at[:live], flat[place], place)
            out[place] = at[:live]
        self._flat = flat
        return out[keep]

    def _back(self, row, at, symbol, place):
        """One LF step of every query; those whose byte differs from their row's jump to a run of it first."""
        run = self.run_of[row].astype(np.int64)
        jump = np.flatnonzero((self.run_symbol[run] != symbol) | (at < 0))
        at = at - 1
        lost = np.zeros(0, np.int64)
        if len(jump):
            n_runs, c, was = len(self.run_first), symbol[jump], at[jump] + 1
            nth = np.searchsorted(self.keys, c * n_runs + run[jump])
            has_down, has_up = nth < self.key_begin[c + 1], nth > self.key_begin[c]
            down, up = self.key_run[np.minimum(nth, n_runs - 1)], self.key_run[np.maximum(nth - 1, 0)]
            take_down = has_down.copy()
            i = np.flatnonzero(has_down & has_up & (was >= 0))
            if len(i):
                after = place[jump[i]] + 1
                take_down[i] = self._common(self.at_first[down[i]], after) > self._common(self.at_last[up[i]], after)
            to = np.where(take_down, down, up)
            run[jump] = to
            row = row.copy()
            row[jump] = np.where(take_down, self.run_first[to], self.run_last[to])
            at[jump] = np.where(take_down, self.at_first[to], self.at_last[to]) - 1
            lost = jump[~(has_down | has_up)]
        stepped = self.starts[symbol] + self.before[run] + (row - self.run_first[run])
        stepped[lost], at[lost] = 0, -1
        return stepped, at

    def _hash(self, flat: np.ndarray) -> None:
        every = np.concatenate([self.text, flat])
        powers = np.full(len(every) + 1, _RADIX, np.uint64)
        downs = np.full(len(every) + 1, _INVERSE, np.uint64)
        powers[0] = downs[0] = 1
        table = np.random.default_rng(7).integers(1, 1 << 63, self.end + 2, np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            powers, self._down = np.cumprod(powers, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[every] * powers[:-1], dtype=np.uint64)])

    def _equal(self, text_at: np.ndarray, place: np.ndarray, length) -> np.ndarray:
        """Whether text and queries agree over that length; False where either is too short."""
        a, b = text_at, place + self.n
        fits = (text_at >= 0) & (a + length <= self.n) & (b + length < len(self._sums))
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        length = np.where(fits, length, 0)
        with np.errstate(over="ignore"):
            return fits & ((self._sums[a + length] - self._sums[a]) * self._down[a] == (self._sums[b + length] - self._sums[b]) * self._down[b])

    def _common(self, text_at: np.ndarray, place: np.ndarray, most: int = 255) -> np.ndarray:
        """The length of the common extension, up to most."""
        out = np.zeros(len(text_at), np.int64)
        step = (most + 1) >> 1
        while step:
            out += np.where(self._equal(text_at + out, place + out, step), step, 0)
            step >>= 1
        return out

    def matches(self, queries: Sequence[np.ndarray], length: int, classes: Sequence[int] | None = None) -> np.ndarray:
        """For each byte of the queries in a row, whether the string of that length there is in the text."""
        size = np.array([len(q) for q in queries])
        found = self.pointers(queries, classes)
        place = np.arange(len(found)) + np.repeat(np.arange(len(size)), size)
        return self._equal(found, place, length)
