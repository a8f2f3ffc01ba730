"""Array kernels of the suffix-index operator: window anchors, a run-compressed BWT, matching statistics."""

from __future__ import annotations

import numpy as np

GRAM = 32  # bytes of an anchor
POS_BITS = 22
POS_MASK = np.uint64((1 << POS_BITS) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every position (by doubling: 1, 2, 4, ... bytes)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULT
    m, n = _MULT, 1
    while n < GRAM:
        h = h[:-n] * m + h[n:]
        m, n = m * m, n * 2
    return _mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:len(x) - (w - n)], x[w - n:]) if w > n else x


def window_anchors(data: np.ndarray, piece_of: np.ndarray, window: int):
    """Which anchor each window of ``window`` bytes chooses: the position of its least gram hash.

    ``data`` holds several pieces one after the other, ``piece_of`` their end positions. Equal
    windows choose the same relative position, wherever they stand. Returns, for each run of windows
    of one piece that choose one anchor, ``(anchor hash, anchor, first start, last start)``.
    """
    empty = np.empty(0, np.int64)
    if len(data) < window:
        return np.empty(0, np.uint64), empty, empty, empty
    with np.errstate(over="ignore"):
        g = gram_hashes(data)
    key = (g & ~POS_MASK) | (POS_MASK - np.arange(len(g), dtype=np.uint64))
    chosen = (POS_MASK - (sliding_min(key, window - GRAM + 1) & POS_MASK)).astype(np.int64)
    starts = np.arange(len(chosen))
    piece = np.searchsorted(piece_of, starts, side="right")
    valid = starts + window <= piece_of[piece]
    change = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1]) | (piece[1:] != piece[:-1])))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(chosen)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return g[chosen[first]], chosen[first], first, last


def suffix_order(text: np.ndarray):
    """The suffixes in order (prefix doubling from 7 symbols; only ties are sorted again).

    ``text`` holds symbols below 511. Returns the order and ``(span, ranks)`` of each doubling level.
    """
    n = len(text)
    pad = np.concatenate((text.astype(np.int64) + 1, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | pad[j:j + n]
    del pad
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    ranks = np.empty(n, np.int32)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a tie's rank: its first row
    levels, span = [(7, ranks)], 7
    rows = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows in a tie
    while len(rows):
        who = order[rows]
        nxt = np.where(who + span < n, ranks[np.minimum(who + span, n - 1)].astype(np.int64) + 1, 0)
        key = (ranks[who].astype(np.int64) << 32) | nxt
        o = np.argsort(key, kind="stable")
        who, key = who[o], key[o]
        order[rows] = who
        new = np.concatenate(([True], key[1:] != key[:-1]))
        ranks = ranks.copy()
        ranks[who] = np.maximum.accumulate(np.where(new, rows, 0))
        span *= 2
        levels.append((span, ranks))
        rows = rows[~(new & np.append(new[1:], True))]
    return order, levels


def common_prefix(i: np.ndarray, j: np.ndarray, text: np.ndarray, levels) -> np.ndarray:
    """Length of the common prefix of the suffixes ``i`` and ``j`` of ``text``."""
    n = len(text)
    length = np.zeros(len(i), np.int64)

    def extend(span, equal):
        a, b = i + length, j + length
        more = (a < n) & (b < n) & (equal[np.minimum(a, n - 1)] == equal[np.minimum(b, n - 1)])
        return np.where(more, span, 0)

    span, ranks = levels[-1]
    while (more := extend(span, ranks)).any():  # equal ranks: equal for span symbols, or to the end
        length += more
    for span, ranks in reversed(levels[:-1]):
        length += extend(span, ranks)
    for k in range(levels[0][0] - 1):  # what is below the first level, symbol by symbol
        more = extend(1, text)
        more[length % levels[0][0] != k] = 0
        length += more
    return np.minimum(length, n - np.maximum(i, j))


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with the suffix samples of its run ends.

    Kept are, for each run of equal BWT symbols, its symbol, its length, the suffix at its first and at its last row,
    and how long that suffix agrees with the row before the run and with the row after it. By the LF
    mapping a suffix whose row lies inside a run agrees with its neighbour one symbol less than the
    suffix one place further left does; so the samples determine the matching statistics everywhere.
    """

    def __init__(self, text: np.ndarray):
        order, levels = suffix_order(text)
        n = len(order)
        self.n = n
        bwt = text[order - 1]  # row of suffix 0 wraps to the last symbol
        heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        first = int(np.flatnonzero(order == 0)[0])  # suffix 0 has nothing to its left: a run of its own
        heads = np.union1d(heads, [k for k in (first, first + 1) if k < n])
        tails = np.append(heads[1:], n) - 1
        self.run_symbol = bwt[heads]
        self.run_length = tails - heads + 1
        self.head_suffix = order[heads]
        self.tail_suffix = order[tails]
        up, down = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        if len(heads) > 1:
            up[1:] = common_prefix(order[heads[1:]], order[heads[1:] - 1], text, levels)
            down[:-1] = common_prefix(order[tails[:-1]], order[tails[:-1] + 1], text, levels)
        self.head_agrees, self.tail_agrees = up, down

    def stream(self) -> np.ndarray:
        """Matching statistics of the indexed text against its other places, left to right."""
        out = np.zeros(self.n, np.int64)
        for suffix, agrees in ((self.head_suffix, self.head_agrees), (self.tail_suffix, self.tail_agrees)):
            reach = np.full(self.n, -1, np.int64)
            reach[suffix] = suffix + agrees
            at = np.flatnonzero(reach >= 0)
            last = np.searchsorted(at, np.arange(self.n), side="right") - 1
            here = np.where(last >= 0, reach[at[np.maximum(last, 0)]], 0)
            out = np.maximum(out, here - np.arange(self.n))
        return out
