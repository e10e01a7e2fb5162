"""An FM-index over word numbers: suffix order, wavelet matrix, backward search and sampled positions, all on whole arrays.

A shard's text is a sequence of numbers: 0 separates stretches, words are 1 and up.  Separators count as different and
as less than every word, in order of their places, so no suffix runs past its stretch and no two are equal.
"""

from __future__ import annotations

import numpy as np

#: Symbols are below 2 ** BITS, separators told apart: three of them fit one sortable key.
BITS = 21
MOST = 1 << BITS


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order: keys of three symbols, then ties alone by doubling."""
    n = len(text)
    apart = text == 0
    gaps = int(apart.sum())
    symbol = np.zeros(n + 2, np.int64)
    symbol[:n] = np.where(apart, np.cumsum(apart) - 1, text.astype(np.int64) + gaps)
    if n > MOST or symbol.max() >= 1 << BITS:
        raise ValueError("too many symbols for one index")
    key = symbol[:n] << 2 * BITS | symbol[1 : n + 1] << BITS | symbol[2:]
    order = np.argsort(key)
    key = key[order]
    rows = np.arange(n)
    head = _heads(key, rows)
    rank = np.empty(n, np.int64)
    rank[order] = head
    tied = rows[_tied(key)]
    depth = 3
    while len(tied):
        at = order[tied]
        key = rank[at] << 32 | rank[at + depth]
        new = np.argsort(key)
        key, at = key[new], at[new]
        order[tied] = at
        rank[at] = _heads(key, tied)
        tied = tied[_tied(key)]
        depth *= 2
    return order


def _heads(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each sorted key the row where its run of equal keys begins."""
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    return rows[np.flatnonzero(first)][np.cumsum(first) - 1]


def _tied(key: np.ndarray) -> np.ndarray:
    same = key[1:] == key[:-1]
    return np.append(same, False) | np.append(False, same)


class Bits:
    """A bit vector with rank: how many ones stand before a place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: a bit vector a level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.zeros = [], []
        x = symbols
        for level in reversed(range(self.levels)):
            one = (x >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            x = np.concatenate([zero := x[~one], x[one]])
            self.zeros.append(len(zero))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the occurrences of a symbol before ``at`` end on the last level; less the same of 0 it is their number."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its place on the last level) of each place."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of a text of numbers up to ``top``, which must end with a separator; a position in ``every`` is sampled."""

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        order = suffix_order(text)
        last = text[order - 1]
        self.wavelet = Wavelet(last, top)
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.append(0, np.cumsum(counts))
        symbols = np.arange(top + 1)
        self.shift = self.first[:-1] - self.wavelet.place(symbols, np.zeros(top + 1, np.int64))
        # The walk back never steps over a separator: places behind one are sampled too.
        known = (order % every == 0) | (last == 0)
        self.known, self.samples = Bits(known), order[known]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) rows of the suffixes that begin with each phrase; rows of ``phrases`` are padded at the right."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.flatnonzero(lengths > 0)
        c = phrases[alive, lengths[alive] - 1]
        low[alive], high[alive] = self.first[c], self.first[c + 1]
        step = 1
        while len(alive):
            alive = alive[low[alive] < high[alive]]
            alive = alive[lengths[alive] > step]
            c = phrases[alive, lengths[alive] - 1 - step]
            low[alive] = self.shift[c] + self.wavelet.place(c, low[alive])
            high[alive] = self.shift[c] + self.wavelet.place(c, high[alive])
            step += 1
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix: walked back to a sampled one."""
        out, at, which, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(at):
            here = self.known.get(at)
            out[which[here]] = self.samples[self.known.rank(at[here])] + steps
            at, which = at[~here], which[~here]
            symbol, place = self.wavelet.access(at)
            at = self.shift[symbol] + place
            steps += 1
        return out
