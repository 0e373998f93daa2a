"""An FM-index over a sequence of word numbers: suffix order, wavelet-tree ranks, sampled positions.

The sequence is cut into chunks, each closed by a mark of its own, so that suffixes are told apart after a chunk's length at
most, however often a passage repeats. Everything works on whole numpy arrays.
"""

from __future__ import annotations

import numpy as np

#: Words of a chunk, and the distance between positions that the index keeps.
CHUNK, SAMPLE = 128, 8


class Ranks:
    """A wavelet tree, level by level: of each bit of the symbols, how often it is set before a place."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = []
        for bit in range(max(int(top).bit_length(), 1) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in the last level of `symbol` for the place `at` in the first."""
        for bit, words, before, zeros in self.levels:
            ones = self._ones(words, before, at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and its place in the last level."""
        found = np.zeros(len(at), np.int64)
        for _, words, before, zeros in self.levels:
            one = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(words, before, at)
            at = np.where(one, zeros + ones, at - ones)
            found = found << 1 | one
        return found, at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes' starts in order. 0 is a chunk's closing mark: each is a symbol of its own, in the order of their places."""
    n = len(symbols)
    marks = symbols == 0
    first = np.where(marks, np.cumsum(marks) - 1, symbols + int(marks.sum()) - 1).astype(np.int64)
    bits = int(first.max()).bit_length()
    h = max(1, min(62 // max(bits, 1), 8))
    key = np.zeros(n, np.int64)
    for k in range(min(h, n)):  # the first h symbols in one number
        key[: n - k] |= first[k:] << (h - 1 - k) * bits
    order = np.argsort(key, kind="stable")
    slots, rank = np.arange(n), np.empty(n, np.int64)
    key = key[order]
    while True:  # only suffixes that are not told apart yet are sorted again, by their next h symbols
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        rank[order[slots]] = slots[starts][np.cumsum(new) - 1]
        open_ = np.repeat(np.diff(np.append(starts, len(slots))) > 1, np.diff(np.append(starts, len(slots))))
        slots = slots[open_]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        h *= 2


class Index:
    """The FM-index of the runs [start, end) of `words` (numbers from 1 to `top`).

    Phrases of at most `longest` words are found wherever they lie inside a run.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, top: int, longest: int) -> None:
        chunk = max(CHUNK, 2 * longest)
        step, lengths = chunk - (longest - 1), ends - starts
        count = np.maximum(1, -(-(lengths - (longest - 1)) // step))
        run = np.repeat(np.arange(len(starts)), count)
        begin = starts[run] + (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * step
        size = np.minimum(begin + chunk, ends[run]) - begin + 1  # with the closing mark
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(begin, size) + inside
        marks = inside == np.repeat(size - 1, size)
        symbols = np.where(marks, 0, words[np.where(marks, 0, word)]).astype(np.int64)
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.ranks = Ranks(symbols[order - 1], top)
        every = np.arange(top + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])[:-1]
        self.shift = self.below - self.ranks.down(every, np.zeros(top + 1, np.int64))
        self.kept = (inside % SAMPLE == 0)[order]
        self.before = np.cumsum(self.kept) - 1
        self.places = word[order[self.kept]]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: rows of word numbers, aligned right, -1 where a phrase has no more words and
        0 for a word that isn't here. Returns each occurrence's phrase and the number of its first word."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        found = []
        for k in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[which, k]
            over = word < 0
            found.append((which[over], low[over], high[over]))
            which, low, high, word = (x[~over] for x in (which, low, high, word))
            low, high = (self.ranks.down(word, x) + self.shift[word] for x in (low, high))
            live = (low < high) & (word > 0)
            which, low, high = which[live], low[live], high[live]
        which, low, high = (np.concatenate(x) for x in zip(*found, (which, low, high)))
        times = high - low
        rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return np.repeat(which, times), self._places(rows)

    def _places(self, rows: np.ndarray) -> np.ndarray:
        """The words at which the suffixes of some rows start: steps back to a position that was kept."""
        places = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            known = self.kept[rows]
            places[open_[known]] = self.places[self.before[rows[known]]] + steps
            open_, rows = open_[~known], rows[~known]
            symbol, last = self.ranks.symbol(rows)
            rows = last + self.shift[symbol]
            steps += 1
        return places
