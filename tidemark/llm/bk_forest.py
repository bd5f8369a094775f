"""BK-trees over fingerprints, one for each shard, searched for many fingerprints at once.

A node is a fingerprint; its children are keyed by their integer Hamming distance to it, one to a distance. All trees of a batch
of shards are built and searched level by level in flat arrays: edges are sorted by (parent, distance), so the edges that a
search may follow, those whose distance lies within the radius of the query's own distance to the parent, are one range.
"""

from __future__ import annotations

import numpy as np

_SPAN = 1 << 16
#: (query, node) pairs that a search may hold at once, for each level of the trees.
_WIDTH = 1 << 17


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, by row; a and b hold unsigned 64-bit words by column."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """values: fingerprints (rows of unsigned 64-bit words); shards: ascending shard numbers. Each shard has a tree."""

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        self.values = values.reshape(len(values), -1) if len(values) else values.reshape(0, 1)
        left = np.arange(len(values))
        first = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)) if len(shards) else left
        self.size = np.diff(np.append(first, len(left)))
        self.root = np.repeat(first, self.size)
        parents, distances, children = [], [], []
        heads, sizes = first, self.size  # positions in `left` of the groups' first items: these are the nodes
        while len(left):
            node = np.repeat(left[heads], sizes)
            rest = np.ones(len(left), bool)
            rest[heads] = False
            left, node = left[rest], node[rest]
            far = hamming(self.values[left], self.values[node])
            order = np.lexsort((left, far, node))
            left, node, far = left[order], node[order], far[order]
            code = node * _SPAN + far
            heads = np.flatnonzero(np.diff(code, prepend=-1))
            sizes = np.diff(np.append(heads, len(code)))
            parents.append(node[heads])
            distances.append(far[heads])
            children.append(left[heads])
        code = np.concatenate([np.empty(0, np.int64), *parents]) * _SPAN + np.concatenate([np.empty(0, np.int64), *distances])
        order = np.argsort(code)
        self.code, self.child = code[order], np.concatenate([np.empty(0, np.int64), *children]).astype(np.int64)[order]

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, found, distance): for each position asked, those of its shard at most `radius` bits away, itself too."""
        out = []
        query, node = asked, self.root[asked]
        while len(query):
            far = hamming(self.values[query], self.values[node])
            hit = far <= radius
            out.append((query[hit], node[hit], far[hit]))
            lo = np.searchsorted(self.code, node * _SPAN + np.maximum(far - radius, 0))
            n = np.searchsorted(self.code, node * _SPAN + far + radius, side="right") - lo
            query = np.repeat(query, n)
            node = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def searches(self, radius: int):
        """within() for all positions, in parts of bounded size."""
        cost = np.cumsum(np.repeat(self.size, self.size))
        at = 0
        while at < len(cost):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _WIDTH, side="right")))
            yield self.within(np.arange(at, end), radius)
            at = end


def roots(part: np.ndarray) -> np.ndarray:
    """Follows pointers to smaller positions to their ends."""
    while not np.array_equal(up := part[part], part):
        part = up
    return part


def unite(part: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts after joining all pairs, which of the pairs suffice for that: a forest, shortest pairs first).

    part: the smallest position of each position's part. Each round takes the shortest pair of each part, so parts at
    least halve.
    """
    chosen = [np.empty(0, np.int64)]
    while True:
        x, y = part[a], part[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return part, np.concatenate(chosen)
        lo, hi = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
        order = np.lexsort((lo, far[open_], hi))  # a larger part hangs on one smaller part, so no circle can arise
        take = order[np.diff(hi[order], prepend=-1) != 0]
        part = part.copy()
        part[hi[take]] = lo[take]
        part = roots(part)
        chosen.append(open_[take])
