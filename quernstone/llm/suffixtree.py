"""Longest common extensions of a sequence of whole numbers, by suffix trees.

Ukkonen's algorithm builds the tree from left to right; its Euler tour, with a range-minimum table over the tour's
string depths, gives the length of the longest common prefix of any two suffixes in constant time, here for arrays
of pairs at once.  Children are visited in order of their symbols, so the leaves' order is that of the suffixes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16


def ukkonen(s: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """Tree of ``s``, whose last symbol, 0, stands nowhere else: edge starts and ends of the nodes (0: the root),
    children by node * symbols + first symbol of the edge, and the leaf of each suffix."""
    n = len(s)
    start, end, link, child, leaves = [0], [0], [0], {}, []
    node = edge = length = left = 0
    for i, c in enumerate(s):
        fresh = 0  # the inner node made last, whose suffix link is still open
        left += 1
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                end.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin = start[to]
                along = min(end[to], i + 1) - begin
                if length >= along:
                    edge += along
                    length -= along
                    node = to
                    continue
                if s[begin + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split = len(start)
                child[key] = split
                start.append(begin)
                end.append(begin + length)
                link.append(0)
                child[split * symbols + c] = split + 1
                leaves.append(split + 1)
                start.append(i)
                end.append(n)
                link.append(0)
                start[to] = begin + length
                child[split * symbols + s[begin + length]] = to
                if fresh:
                    link[fresh] = split
                fresh = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, child, leaves


class RangeMinimum:
    """Minimum of any stretch of an array in constant time: minima within blocks, and a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        self.values[: len(values)] = values
        rows = self.values.reshape(blocks, BLOCK)
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            below, by = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(below[:-by], below[by:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], for arrays of ends."""
        a, b = first // BLOCK, last // BLOCK
        out = np.minimum(self.since[first], self.upto[last])
        between = b - a - 1
        level = np.frexp(np.maximum(between, 1).astype(float))[1] - 1
        for k in np.unique(level[between > 0]):
            at = np.flatnonzero((between > 0) & (level == k))
            table = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(table[a[at] + 1], table[b[at] - 2**k]))
        near = np.flatnonzero(a == b)
        if len(near):
            lo, hi = first[near], last[near]
            least = self.values[lo]
            for k in range(1, BLOCK):
                at = np.minimum(lo + k, hi)
                least = np.minimum(least, self.values[at])
            out[near] = least
        return out


class Extensions:
    """Suffixes of ``s`` (symbols from 1 on): the rank of each, and how far two of them agree."""

    def __init__(self, s: list[int], symbols: int):
        symbols += 1
        start, end, child, leaves = ukkonen([*s, 0], symbols)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        to = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        del child
        order = np.argsort(keys)
        parents, kids = keys[order] // symbols, to[order].tolist()
        where = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        span = (np.asarray(end) - np.asarray(start)).tolist()
        # Euler tour: a node's string depth when it is entered and after each child
        tour, seen, depth = [], [0] * len(start), [0] * len(start)
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            seen[v] = len(tour)
            tour.append(d)
            back = ~v
            for k in range(where[v + 1] - 1, where[v] - 1, -1):
                kid = kids[k]
                depth[kid] = d + span[kid]
                stack.append(back)
                stack.append(kid)
        self.first = np.asarray(seen, dtype=np.int64)[np.asarray(leaves)]
        self.minimum = RangeMinimum(np.asarray(tour, dtype=np.int32))
        self.rank = np.empty(len(self.first), dtype=np.int64)
        self.rank[np.argsort(self.first)] = np.arange(len(self.first))

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes from i and from j on (different places)."""
        a, b = self.first[i], self.first[j]
        return self.minimum.of(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def next_lower(rank: np.ndarray) -> np.ndarray:
    """Next place whose value is lower, or -1."""
    out, waiting = [-1] * len(rank), []
    for j, r in enumerate(rank.tolist()):
        while waiting and waiting[-1][1] > r:
            out[waiting.pop()[0]] = j
        waiting.append((j, r))
    return np.asarray(out, dtype=np.int64)


def maximal_runs(s: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal repetition of ``s`` with at least two periods, by start and period.

    The longest Lyndon word from each place on, in the symbols' order and in its reverse, ends before the next suffix that is
    lower or higher; every repetition has one of them as a root.  Each is extended to both sides as far as
    the symbols one root apart agree."""
    n = len(s)
    ahead, back = Extensions(s, symbols), Extensions(s[::-1], symbols)
    start, to = [], []
    for rank in (ahead.rank, -ahead.rank):
        until = next_lower(rank)
        i = np.flatnonzero(until >= 0)
        i = i[i < n]
        start.append(i)
        to.append(until[i])
    i, j = np.concatenate(start), np.concatenate(to)
    right, left = ahead.agree(i, j), back.agree(n - i, n - j)
    begin, length, period = i - left, left + right + (j - i), j - i
    found = length >= 2 * period
    rows = np.unique(np.column_stack([begin[found], period[found], length[found]]), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]
