"""An FM-index over runs of word numbers: suffix array, wavelet-matrix ranks, sampled positions. All steps are vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """Of a text of symbols 0..top, where every 0 is a separator of its own, ordered by its place.

    The first key packs as many symbols as fit 62 bits, up to the first separator; tied groups are then refined by
    doubling. A suffix is settled once a separator is within the compared length.
    """
    n = len(text)
    bits = max(1, int(top).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(depth):
        sym = np.zeros(n, np.int64)
        sym[: max(0, n - k)] = text[k:]
        open_ &= sym > 0
        key = (key << bits) | np.where(open_, sym, 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_[order[1:]]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.zeros(n, bool)
    tied[:-1] = ~fresh[1:]
    tied |= ~fresh
    rows = np.flatnonzero(tied)  # places in the suffix array that are not settled
    while len(rows):
        at = order[rows]
        first, second = rank[at], rank[at + depth]  # a tied suffix has no separator within depth, so at + depth exists
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        tied = np.zeros(len(rows), bool)
        tied[:-1] = ~new[1:]
        tied |= ~new
        rows = rows[tied]
        depth *= 2
    return order


class FMIndex:
    """text: symbols 0..top, 0 separates and is never searched; it ends with 0."""

    def __init__(self, text: np.ndarray, top: int, step: int = 8):
        n = len(text)
        order = suffix_array(text, top)
        self.n, self.bits = n, max(1, int(top).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])  # suffixes that begin with a smaller symbol
        self.bwt = text[order - 1]  # the last symbol is a separator, so this also holds for place 0
        level, self.zeros, self.ranks = self.bwt.copy(), [], []
        base = np.zeros(top + 1, np.int64)
        symbols = np.arange(top + 1)
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(1 - one, out=ranks[1:])
            self.ranks.append(ranks)
            self.zeros.append(int(ranks[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
            base = np.where((symbols >> b) & 1, self.zeros[-1] + base - ranks[base], ranks[base])
        self.base = base
        starts = np.ones(n, bool)
        starts[1:] = text[:-1] == 0
        marked = (starts | (np.arange(n) % step == 0))[order]
        self.marked, self.marked_rank, self.places = marked, np.cumsum(marked) - 1, order[marked]

    def occ(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the first upto places of the BWT."""
        i = upto
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            zeros = self.ranks[k][i]
            i = np.where((symbol >> b) & 1, self.zeros[k] + i - zeros, zeros)
        return i - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: rows of symbols, aligned right, 0 where a pattern is shorter; the range of rows of each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, col]
            live, c = live[c > 0], c[c > 0]
            low[live] = self.before[c] + self.occ(c, low[live])
            high[live] = self.before[c] + self.occ(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array: steps back to the nearest sampled place."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        steps = 0
        while len(live):
            at = rows[live]
            done = self.marked[at]
            out[live[done]] = self.places[self.marked_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            c = self.bwt[at]
            rows[live] = self.before[c] + self.occ(c, at)
            steps += 1
        return out
