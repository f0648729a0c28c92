"""A compressed FM-index of word segments: suffix order, wavelet matrix of packed bits, vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; quick when suffixes differ early, as they do with unique separators."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = fresh, step * 2
    return order


class Bits:
    """Packed bits with a count for each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of segments (arrays of word codes); each segment has an owner, and the smallest owner of a range can be asked."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray) -> None:
        lengths = np.array([len(s) for s in segments], np.int64)
        flat = np.concatenate(segments) if segments else np.empty(0, np.uint64)
        words, codes = np.unique(flat, return_inverse=True)
        count = len(segments)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        owner_at = np.repeat(np.arange(count), lengths + 1)
        self.text = np.empty(len(flat) + count, np.int64)
        inside = np.ones(len(self.text), bool)
        ends = self.starts + lengths
        inside[ends] = False
        self.text[inside] = codes + count  # separators are the codes 0, 1, ...: all different
        self.text[ends] = np.arange(count)
        order = suffix_order(self.text)
        last = self.text[order - 1]
        sigma = count + len(words)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        column = last
        for level in range(self.depth - 1, -1, -1):
            bit = (column >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.origin = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))
        least = owners[owner_at[order]]
        self.least = [least]
        width = 1
        while 2 * width <= len(order):
            least = np.minimum(least[:-width], least[width:])
            self.least.append(least)
            width *= 2

    def descend(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the last column arrives under ``code`` in the wavelet matrix."""
        for k, bits in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(code >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the ranges of ``code`` followed by what the ranges stand for."""
        base = self.first[code] - self.origin[code]
        return base + self.descend(code, low), base + self.descend(code, high)

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each range, which must not be empty."""
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for p in np.unique(power):
            at = power == p
            out[at] = np.minimum(self.least[p][low[at]], self.least[p][high[at] - (1 << int(p))])
        return out

    def covered(self, owners: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(segment, offset) of each window of a segment that also occurs in a segment of a smaller owner.

        The matching statistic of a position is followed to the left, up to ``window`` words, and given up
        as soon as no smaller owner is left in the range.
        """
        segment = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        end, own = self.starts[segment] + offset + window, owners[segment]
        low, high = np.zeros(len(segment), np.int64), np.full(len(segment), len(self.text), np.int64)
        live = np.arange(len(segment))
        for back in range(1, window + 1):
            if not len(live):
                break
            low, high = self.extend(self.text[end[live] - back], low, high)
            good = self.smallest(low, high) < own[live]
            live, low, high = live[good], low[good], high[good]
        return segment[live], offset[live]
