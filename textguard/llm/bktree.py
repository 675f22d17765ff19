"""BK-trees over fingerprints of one or more 64-bit words, many trees at a time, in numpy.

The children of a node are keyed by their Hamming distance to it; a search within a radius
follows only the edges whose key differs from the distance at hand by no more than the radius.
"""

from __future__ import annotations

import numpy as np

PAIRS = 1 << 20  # visits under way at once


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One tree for each value of ``group``; ``prints`` has a row of words per fingerprint."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.prints = prints
        self.edges = 64 * prints.shape[1] + 1
        self.groups, roots, of = np.unique(group, return_index=True, return_inverse=True)
        self.roots = roots
        waiting = np.setdiff1d(np.arange(len(prints)), roots, assume_unique=True)
        node = roots[of[waiting]]
        keys, children = [], []
        while len(waiting):  # once per level
            edge = node * self.edges + distance(prints[waiting], prints[node])
            key, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[first]
            keys.append(key)
            children.append(child)
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            node, waiting = child[inverse][rest], waiting[rest]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.child = np.concatenate(children)[order] if children else np.empty(0, np.int64)

    def within(self, group: np.ndarray, prints: np.ndarray, radius: int):
        """Yields (query, node) index arrays of all pairs no further apart than ``radius``."""
        at = np.searchsorted(self.groups, group)
        at[at == len(self.groups)] = 0
        asked = np.flatnonzero(self.groups[at] == group) if len(self.groups) else np.empty(0, np.int64)
        stack = [(asked[i : i + PAIRS], self.roots[at[asked[i : i + PAIRS]]]) for i in range(0, len(asked), PAIRS)]
        while stack:
            query, node = stack.pop()
            apart = distance(prints[query], self.prints[node])
            near = apart <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.key, node * self.edges + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.key, node * self.edges + np.minimum(apart + radius, self.edges - 1), "right")
            many = high - low
            for part in _parts(many):
                n = many[part]
                total = int(n.sum())
                if not total:
                    continue
                begin = np.repeat(low[part] - np.r_[0, np.cumsum(n)[:-1]], n)
                stack.append((np.repeat(query[part], n), self.child[begin + np.arange(total)]))


def _parts(many: np.ndarray):
    """Slices whose sums stay near ``PAIRS``."""
    if not len(many):
        return
    cell = np.cumsum(many) // PAIRS
    cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(many)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield slice(a, b)


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; ``label`` gives each entry the smallest of its class."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return label
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(following := label[label], label):
            label = following
