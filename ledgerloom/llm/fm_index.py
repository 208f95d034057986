"""An FM-index of a sequence of small integers: suffix array, wavelet matrix of its Burrows-Wheeler transform, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order. Several leading symbols are sorted as one number; ties are broken by prefix doubling."""
    n = len(text)
    bits = max(1, int(symbols).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    slots = np.arange(n)
    heads = _heads(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = heads
    tied = _tied(heads)
    while len(tied):
        after = order[tied] + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        joint = rank[order[tied]] * (n + 1) + second
        inner = np.argsort(joint)
        order[tied] = order[tied][inner]
        joint = joint[inner]
        # a group's rank is the slot of its first suffix, so groups that did not split keep theirs
        fresh = np.empty(len(joint), bool)
        fresh[0] = True
        np.not_equal(joint[1:], joint[:-1], out=fresh[1:])
        heads = np.maximum.accumulate(np.where(fresh, slots[tied], 0))
        rank[order[tied]] = heads
        tied = tied[_tied_flags(heads)]
        depth *= 2
    return order


def _heads(ordered: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


def _tied_flags(heads: np.ndarray) -> np.ndarray:
    same = heads[1:] == heads[:-1]
    return np.append(same, False) | np.insert(same, 0, False)


def _tied(heads: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_tied_flags(heads)) if len(heads) else np.zeros(0, np.int64)


class WaveletMatrix:
    """Access and rank over a sequence of integers below 2 ** bits, for many queries at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.split = bits, [], []
        for level in reversed(range(bits)):
            bit = (values >> level) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first at[i] values equal symbol[i]."""
        begin = np.zeros(len(at), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            begin = np.where(one, split + begin - zeros[begin], zeros[begin])
            at = np.where(one, split + at - zeros[at], zeros[at])
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for zeros, split in zip(self.zeros, self.split, strict=True):
            one = zeros[at + 1] == zeros[at]
            value = value * 2 + one
            at = np.where(one, split + at - zeros[at], zeros[at])
        return value


class FMIndex:
    """Finds phrases in a text of integers from 1 to symbols; every step-th suffix position is stored."""

    def __init__(self, text: np.ndarray, symbols: int, step: int = 8):
        text = np.append(text, 0).astype(np.int64)  # the least symbol ends the text
        order = suffix_array(text, symbols)
        self.bits = max(1, int(symbols).bit_length())
        self.tree = WaveletMatrix(text[order - 1], self.bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        kept = order % step == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase. phrases: one a row, right-aligned (the last symbol in the last column)."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, -1] if len(phrases) else np.zeros(0, np.int64)
        low[:], high[:] = self.below[last], self.below[last + 1]
        alive = np.flatnonzero(high > low)
        for back in range(2, phrases.shape[1] + 1):
            at = alive[(lengths[alive] >= back) & (high[alive] > low[alive])]
            if not len(at):
                break
            symbol = phrases[at, -back]
            low[at] = self.below[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.below[symbol] + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks back through the text until a stored position."""
        rows, out = rows.astype(np.int64), np.empty(len(rows), np.int64)
        open_rows, walked = np.arange(len(rows)), 0
        while len(open_rows):
            kept = self.kept_before[rows + 1] > self.kept_before[rows]
            out[open_rows[kept]] = self.positions[self.kept_before[rows[kept]]] + walked
            open_rows, rows = open_rows[~kept], rows[~kept]
            symbol = self.tree.access(rows)
            rows = self.below[symbol] + self.tree.rank(symbol, rows)
            walked += 1
        return out
