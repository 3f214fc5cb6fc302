"""An FM-index over integer symbols: suffix array, wavelet-matrix ranks, sampled suffix positions.

The indexed text is a sequence of symbols in which 0 separates runs. Separators are ordered by their
place, as if each were a symbol of its own, so that suffixes differ at the next separator at the
latest: sorting takes few rounds, and walking back from an occurrence never leaves its run.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions of all suffixes in order. ``text`` ends with 0; symbols have ``bits`` bits."""
    n = len(text)
    place_bits = max(1, int(n).bit_length())
    mask = (1 << place_bits) - 1
    separators = np.flatnonzero(text == 0)
    s = len(separators)
    depth = max(1, (62 - place_bits) // bits)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    for i in range(depth):
        symbol = np.where(alive, padded[i : i + n], 0)
        alive = symbol != 0
        key = (key << bits) | symbol
    key = (key << place_bits) | np.arange(n)
    key = np.sort(key[text != 0])
    order = np.empty(n, dtype=np.int64)
    order[:s] = separators
    order[s:] = key & mask
    group = key >> place_bits
    fresh = np.ones(n - s, dtype=bool)
    fresh[1:] = group[1:] != group[:-1]
    fresh |= (group & ((1 << bits) - 1)) == 0
    rank = np.empty(n, dtype=np.int64)
    rank[separators] = np.arange(s)
    starts = np.flatnonzero(fresh)
    rank[order[s:]] = starts[np.cumsum(fresh) - 1] + s
    last = np.ones(n - s, dtype=bool)
    last[:-1] = fresh[1:]
    rows = np.flatnonzero(~(fresh & last)) + s
    while len(rows):
        p = order[rows]
        key = np.sort((((rank[p] << place_bits) | rank[p + depth]) << place_bits) | p)
        p = key & mask
        order[rows] = p
        group = key >> place_bits
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = group[1:] != group[:-1]
        starts = np.flatnonzero(fresh)
        rank[p] = rows[starts[np.cumsum(fresh) - 1]]
        last = np.ones(len(rows), dtype=bool)
        last[:-1] = fresh[1:]
        rows = rows[~(fresh & last)]
        depth *= 2
    return order


class Bits:
    """A bit vector with constant-time rank: 64-bit words and their running popcounts."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, dtype=bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.blocks = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.blocks[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.blocks[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Backward search and location of symbol patterns in one shard."""

    #: The longest text of one index: two ranks and a place share one 64-bit sort key.
    MOST = (1 << 20) - 1
    SAMPLE = 16

    def __init__(self, text: np.ndarray, sigma: int):
        if len(text) > self.MOST or not len(text) or text[-1]:
            raise ValueError("a shard has 1 to MOST symbols and ends with a separator")
        bits = max(1, int(sigma - 1).bit_length())
        order = suffix_array(text, bits)
        before = text[order - 1]
        before[order == 0] = 0
        self.counts = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.counts[1:])
        self.bits, self.levels, self.zeros = bits, [], []
        values, self.begin = before, np.zeros(sigma, dtype=np.int64)
        symbols = np.arange(sigma)
        for level in reversed(range(bits)):
            flags = (values >> level) & 1 == 1
            layer = Bits(flags)
            zeros = len(flags) - int(flags.sum())
            self.levels.append(layer)
            self.zeros.append(zeros)
            ones = layer.rank(self.begin)
            self.begin = np.where((symbols >> level) & 1 == 1, zeros + ones, self.begin - ones)
            values = np.concatenate([values[~flags], values[flags]])
        sampled = (order % self.SAMPLE == 0) | (before == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before row i of the transformed text."""
        at = i
        for k, layer in enumerate(self.levels):
            ones = layer.rank(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, with their row ranges. Patterns are right-aligned in a matrix."""
        width = patterns.shape[1]
        live = np.flatnonzero(lengths > 0)
        last = patterns[live, width - 1]
        low, high = self.counts[last], self.counts[last + 1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, width + 1):
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            done = lengths[live] == step
            found.append((live[done], low[done], high[done]))
            live, low, high = live[~done], low[~done], high[~done]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            low, high = self.counts[symbol] + self.rank(symbol, low), self.counts[symbol] + self.rank(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the nearest sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        index, row, steps = np.arange(len(rows)), rows, 0
        while len(index):
            here = self.sampled.get(row)
            out[index[here]] = self.places[self.sampled.rank(row[here])] + steps
            index, row = index[~here], row[~here]
            symbol, at = np.zeros(len(row), dtype=np.int64), row
            for k, layer in enumerate(self.levels):
                one, ones = layer.get(at), layer.rank(at)
                symbol = (symbol << 1) | one
                at = np.where(one, self.zeros[k] + ones, at - ones)
            row = self.counts[symbol] + at - self.begin[symbol]
            steps += 1
        return out
