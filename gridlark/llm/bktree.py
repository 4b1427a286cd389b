"""BK-trees over 64-bit fingerprints, built and searched with numpy, many trees (a forest) at once.

A node's children are keyed by their Hamming distance to it. All points of a tree enter at its root; at each level
the first point of a (node, distance) group becomes that child and the others go below it. A search visits a child
only if its key is within the radius of the query's distance to the parent (triangle inequality), so nothing is lost."""

from __future__ import annotations

import numpy as np


def build(points: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, key (distance to the parent) and level of every point; roots have parent -1. `tree` numbers each
    point's tree; the first point of a tree is its root."""
    n = len(points)
    parent, key, level = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, first, which = np.unique(tree, return_index=True, return_inverse=True)
    at = first[which]  # the node that each point has come to
    todo = np.setdiff1d(np.arange(n), first)
    at, depth = at[todo], 1
    while len(todo):
        d = np.bitwise_count(points[todo] ^ points[at]).astype(np.int64)
        group = at * 128 + d
        _, lead, which = np.unique(group, return_index=True, return_inverse=True)
        child = todo[lead]
        parent[child], key[child], level[child] = at[lead], d[lead], depth
        stay = np.ones(len(todo), bool)
        stay[lead] = False
        at, todo, depth = child[which][stay], todo[stay], depth + 1
    return parent, key, level


def pairs_within(points: np.ndarray, tree: np.ndarray, radius: int, block: int = 1024, ask: np.ndarray | None = None):
    """Yields arrays (i, j), i < j: the pairs of one tree within the radius. Queries go in blocks to bound memory.
    With `ask` (a mask of the points) only those points search, which gives the pairs with one of them at least."""
    n = len(points)
    if not n:
        return
    parent, key, _ = build(points, tree)
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n))
    many = np.searchsorted(parent[order], np.arange(n), "right") - first
    roots = np.flatnonzero(parent < 0)
    _, which = np.unique(tree, return_inverse=True)
    root_of = np.empty(which.max() + 1, np.int64)
    root_of[which[roots]] = roots
    queries = np.arange(n) if ask is None else np.flatnonzero(ask)
    for a in range(0, len(queries), block):
        q = queries[a : a + block]
        node = root_of[which[q]]
        while len(q):
            d = np.bitwise_count(points[q] ^ points[node]).astype(np.int64)
            hit = (d <= radius) & ((q < node) if ask is None else (q < node) | ((q > node) & ~ask[node]))
            if hit.any():
                yield np.minimum(q[hit], node[hit]), np.maximum(q[hit], node[hit])
            down = many[node] > 0
            q, node, d = q[down], node[down], d[down]
            times = many[node]
            total = int(times.sum())
            step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
            child = order[np.repeat(first[node], times) + step]
            q, d = np.repeat(q, times), np.repeat(d, times)
            go = np.abs(key[child] - d) <= radius
            q, node = q[go], child[go]


def components(n: int, pairs) -> np.ndarray:
    """For each of n points the least index it is linked to by the pairs."""
    label = np.arange(n)

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for x, y in pairs:
        live = label[x] != label[y]
        for i, j in zip(x[live].tolist(), y[live].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                label[max(a, b)] = min(a, b)
    while True:
        new = label[label]
        if (new == label).all():
            return label
        label = new
