"""A compressed FM-index over sequences of symbols, searched for many patterns at once.

Suffixes are ordered by their first DEPTH symbols, which is enough to search for anything shorter. What is kept, for n
symbols of an alphabet of s:

* the transform, in a wavelet matrix: log2(s) bit vectors of n bits with a count for every 64 bits;
* the lengths that neighbouring suffixes share, one byte each, with the least of every 64 and a sparse table of minima
  over those blocks alone;
* a bit for each suffix that shares less than `window` symbols with the one before it. The suffixes between two such
  bits begin with the same `window` symbols; of each such group the least owner is kept.

The suffix array itself goes after building: no place is ever asked for but the owner of a group. Backward search keeps
an interval of suffixes for each pattern; where it cannot be extended, the interval is widened to its parent. That gives
matching statistics: for each position of a pattern, the length of the longest match that begins there, and the least
owner of the matches of `window` symbols or more.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
DEPTH = 128
SEPARATOR = 0
_BLOCK = 64


class Bits:
    """A bit vector with a count for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = places >> 6
        return self.counts[block] + np.bitwise_count(self.words[block] & ((U(1) << (places & 63).astype(np.uint64)) - U(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.vectors, self.zeros = [], []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (rest >> level & 1).astype(np.uint8)
            self.vectors.append(Bits(bits))
            self.zeros.append(int(self.n - bits.sum()))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        self.first = self._walk(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, vector, zeros in zip(range(self.levels - 1, -1, -1), self.vectors, self.zeros, strict=True):
            ones = vector.rank(places)
            places = np.where(symbols >> level & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        return self._walk(symbols, places) - self.first[symbols]


def _ordered(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first DEPTH symbols, and the symbols that each shares with the one before it."""
    n = len(symbols)
    ranks, length = [symbols.astype(np.int32)], 1
    order = np.argsort(symbols, kind="stable")
    while length < DEPTH:
        now = ranks[-1].astype(np.int64)
        key = now * (int(now.max(initial=0)) + 2)
        key[: max(0, n - length)] += now[length:] + 1
        order = np.argsort(key)
        moved = key[order]
        new = np.zeros(n, np.int32)
        new[order] = np.concatenate([[0], np.cumsum(moved[1:] != moved[:-1])])
        ranks.append(new)
        length *= 2
        if n and new[order[-1]] == n - 1:  # all differ
            break
    a, b, same = order[:-1], order[1:], np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + same, b + same
        inside = (x < n) & (y < n)
        equal = inside & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        same = np.where(equal, np.minimum(same + (1 << level), DEPTH), same)
    return order, same


class FMIndex:
    """Symbols are 1 to sigma - 1; SEPARATOR stands between sequences and is in no pattern."""

    def __init__(self, symbols: np.ndarray, sigma: int, owners: np.ndarray, window: int):
        symbols = np.append(symbols, SEPARATOR)  # so that every symbol of a sequence has one after it
        n = self.n = len(symbols)
        order, same = _ordered(symbols)
        shared = np.zeros((n // _BLOCK + 1) * _BLOCK, np.uint8)  # of suffix i with suffix i - 1; 0 at both ends
        shared[1:n] = same
        self.shared = shared.reshape(-1, _BLOCK)
        self.least = [self.shared.min(axis=1)]
        while 2 ** len(self.least) <= len(self.shared):
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.window, heads = window, shared[:n] < window
        self.heads = Bits(heads.astype(np.uint8))
        self.owners = np.minimum.reduceat(np.append(owners, np.iinfo(np.int64).max)[order], np.flatnonzero(heads))
        before = symbols[order - 1].copy()
        before[order == 0] = SEPARATOR
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.transform = WaveletMatrix(before, sigma)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on as before: one step of backward search."""
        both = self.transform.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.starts[symbols]
        return start + both[: len(low)], start + both[len(low) :]

    def _smaller(self, places: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
        """The nearest place from each one on, downwards (step -1) or upwards (1), that shares less than `length`."""
        block, column = places // _BLOCK, np.arange(_BLOCK)
        side = (column <= (places % _BLOCK)[:, None]) if step < 0 else (column >= (places % _BLOCK)[:, None])
        within = side & (self.shared[block] < length[:, None])
        away = np.flatnonzero(~within.any(axis=1))
        if len(away):
            at, bound = block[away] + step, length[away]
            for level in range(len(self.least) - 1, -1, -1):  # past blocks whose least is not smaller
                table, width = self.least[level], 1 << level
                edge = at - width + 1 if step < 0 else at
                ok = (edge >= 0) & (edge < len(table))
                go = ok & (table[np.where(ok, edge, 0)] >= bound)
                at = np.where(go, at + step * width, at)
            block[away] = at
            within[away] = self.shared[at] < bound[:, None]
        inner = _BLOCK - 1 - within[:, ::-1].argmax(axis=1) if step < 0 else within.argmax(axis=1)
        return block * _BLOCK + inner

    def _lengths(self, places: np.ndarray) -> np.ndarray:
        return self.shared[places // _BLOCK, places % _BLOCK].astype(np.int64)

    def parents(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, and the length that all suffixes in each share."""
        length = np.maximum(self._lengths(low), self._lengths(high))
        wide = np.flatnonzero(length)
        new_low, new_high = np.zeros_like(low), np.full_like(high, self.n)
        if len(wide):
            new_low[wide] = self._smaller(low[wide], length[wide], -1)
            new_high[wide] = np.minimum(self._smaller(high[wide], length[wide], 1), self.n)
        return new_low, new_high, length

    def matching_statistics(self, patterns: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the patterns patterns[bounds[i]:bounds[i + 1]]: the length of the longest match from
        there on, DEPTH - 2 standing for any longer one, and the least owner of the matches of `window` symbols (the
        largest number if there is none). All patterns go on in step."""
        lengths, places = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        at, end = bounds[1:] - 1, bounds[:-1]
        keep = at >= end
        at, end = at[keep], end[keep]
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while len(at):
            # at the depth that the order of suffixes reaches, the match is cut by its last symbol, and goes on
            full = np.flatnonzero(length == DEPTH - 2)
            if len(full):
                length[full] -= 1
                low[full], high[full] = self._smaller(low[full], length[full], -1), np.minimum(self._smaller(high[full], length[full], 1), self.n)
            new_low, new_high = self.extend(low, high, patterns[at])
            found = new_low < new_high
            low, high = np.where(found, new_low, low), np.where(found, new_high, high)
            length = length + found
            done = found | (length == 0)
            lengths[at[done]], places[at[done]] = length[done], low[done]
            stuck = np.flatnonzero(~done)
            if len(stuck):
                low[stuck], high[stuck], length[stuck] = self.parents(low[stuck], high[stuck])
            at = at - done
            keep = at >= end
            if not keep.all():
                at, end, low, high, length = at[keep], end[keep], low[keep], high[keep], length[keep]
        owners = np.full(len(patterns), np.iinfo(np.int64).max)
        long = np.flatnonzero(lengths >= self.window)
        owners[long] = self.owners[self.heads.rank(places[long] + 1) - 1]
        return lengths, owners
