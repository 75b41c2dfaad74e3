"""Suffix sorting of byte strings by induction, a symbol's bucket at a time.

A suffix is of type S if it is smaller than the one after it, else of type L; the leftmost S of a run is LMS. From
sorted LMS suffixes all L suffixes are induced in rising order and then all S suffixes in falling order: whoever
leaves the queue pushes the suffix that starts one symbol before it. The queue is a monotone priority queue with one
first-in-first-out run for every symbol: what is pushed never belongs before what is being read. So a whole bucket is
read, and its predecessors pushed, in one vector step (one more for each repetition of a symbol). Runs longer than
``spill`` entries go to an unnamed temporary file of the task and come back by memory map when their bucket is read.

LMS suffixes are sorted by naming the LMS substrings (induced first) and sorting the string of names in turn, here by
doubling ranks, which stops once ``depth`` symbols are told apart: callers need the order of the first ``depth``
symbols only.
"""

from __future__ import annotations

import tempfile

import numpy as np

from plumbline.llm.bytescan import mix, powers

SPILL = 1 << 22


class BucketQueue:
    """For each symbol a first-in-first-out run of positions; long runs are on disk."""

    def __init__(self, symbols: int, spill: int = SPILL):
        self.runs: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.held, self.spill = 0, spill

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """In order; symbols are uint8."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(symbols)], strict=True):
            self._append(int(symbols[a]), positions[a:b])

    def _append(self, symbol: int, part: np.ndarray) -> None:
        self.held += len(part)
        if self.held > self.spill:
            with tempfile.TemporaryFile() as f:  # unlinked at once; the map keeps it until the bucket is read
                f.write(part.tobytes())
                f.flush()
                part = np.memmap(f, dtype=part.dtype, mode="r", shape=part.shape)
            self.held -= len(part)
        self.runs[symbol].append(part)

    def take(self, symbol: int) -> np.ndarray:
        parts, self.runs[symbol] = self.runs[symbol], []
        self.held -= sum(len(p) for p in parts if not isinstance(p, np.memmap))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last symbol is L (an imagined smaller one follows)."""
    n = len(text)
    rises = np.zeros(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    differs = np.ones(n, dtype=bool)
    differs[:-1] = text[:-1] != text[1:]
    where = np.flatnonzero(differs)
    return rises[where[np.searchsorted(where, np.arange(n))]]


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, spill: int = SPILL) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes (within each symbol) leads to."""
    symbols = int(text.max()) + 1
    queue = BucketQueue(symbols, spill)
    seeds = BucketQueue(symbols, spill)
    seeds.push(text[lms], lms)
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    last = np.array([len(text) - 1], dtype=np.int32)
    queue.push(text[last], last)

    def before(at: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        p = at[at > 0] - 1
        p = p[is_s[p] == want_s]
        return p, text[p]

    for c in range(symbols):
        now = queue.take(c)
        while len(now):
            large[c].append(now)
            p, s = before(now, False)
            queue.push(s[s != c], p[s != c])
            now = p[s == c]
        p, s = before(seeds.take(c), False)
        queue.push(s, p)
    small: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        now = queue.take(c)
        while len(now):
            small[c].append(now)
            p, s = before(now, True)
            queue.push(s[s != c], p[s != c])
            now = p[s == c]
        for part in reversed(large[c]):
            p, s = before(part[::-1], True)
            queue.push(s, p)
    none = np.zeros(0, dtype=np.int32)
    return np.concatenate([none, *(x for c in range(symbols) for x in (*large[c], *(y[::-1] for y in reversed(small[c]))))])


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, by place in the text, given the LMS positions in the order of their substrings."""
    power, inverse = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    ends = np.minimum(np.append(lms[1:], len(text) - 1) + 1, len(text))
    prints = mix((sums[ends] - sums[lms]) * inverse[lms] ^ mix((ends - lms).astype(np.uint64)))
    rank_at = np.empty(len(lms), dtype=np.int64)
    place = np.searchsorted(lms, ordered)
    p = prints[place]
    rank_at[place] = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
    return rank_at


def suffix_order(text: np.ndarray, depth: int, spill: int = SPILL) -> np.ndarray:
    """Start positions in the order of their suffixes, exact for the first ``depth`` symbols. text: uint8."""
    if not len(text):
        return np.zeros(0, dtype=np.int32)
    is_s = suffix_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if not len(lms):
        return induce(text, is_s, lms, spill)
    first = induce(text, is_s, lms, spill)
    mark = np.zeros(len(text), dtype=bool)
    mark[lms] = True
    ordered = first[mark[first]]
    rank = _names(text, lms, ordered)
    order = np.searchsorted(lms, ordered)
    # an LMS substring has two symbols at least that the next one does not repeat
    told, n = 1, len(lms)
    while 2 * told <= depth + 2 and int(rank.max()) < n - 1:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - told] = rank[told:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        told *= 2
    return induce(text, is_s, lms[order], spill)


def equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each position in ``order`` whether the ``length`` symbols there equal those at the position before it.

    All positions have ``length`` symbols after them. Compared eight symbols at a time, those that still agree.
    """
    words = np.ndarray((max(len(text) - 7, 0),), dtype=np.uint64, buffer=np.ascontiguousarray(text), strides=(1,))
    same = np.zeros(len(order), dtype=bool)
    open_ = np.arange(1, len(order))
    for k in [*range(0, length - 8, 8), length - 8]:
        if not len(open_):
            break
        open_ = open_[words[order[open_] + k] == words[order[open_ - 1] + k]]
    same[open_] = True
    return same
