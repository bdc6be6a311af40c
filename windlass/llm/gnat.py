"""Geometric near-neighbour access tree over a short list of integer points.

A node picks split points, files every other point under its nearest one, and
stores for each pair (split, child) the range of the distances from the split
to the child's points.  A query's distance to a split, compared with such a
range, bounds its distance to all of the child from below; a child strictly
farther than the best point so far is left out whole.  Distances of split
points are rounded outward, so a bound is never too high; candidates are
compared by exact integer squared distance, ties by the lower index.

Queries are searched in batches: a node is visited once, by the rows that
still need it.
"""

from __future__ import annotations

import numpy as np

#: Points up to which a node is a plain list; split points of a node.
LEAF, SPLITS = 12, 12
_FAR = np.iinfo(np.int64).max


def squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all rows of q to all of p."""
    most = max((int(np.abs(x).max()) for x in (q, p) if x.size), default=0)
    if 4 * most * most * max(q.shape[1], 1) < 1 << 53:          # exact in doubles, too
        a, b = q.astype(np.float64), p.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((q - x) ** 2).sum(1) for x in p], 1)


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


class _Node:
    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.ids, self.children = ids, []
        if len(ids) > LEAF:
            # Split points far from one another, the first id being the first.
            at, near = [0], squared(points[ids], points[ids[:1]])[:, 0]
            while len(at) < SPLITS:
                at.append(int(near.argmax()))
                near = np.minimum(near, squared(points[ids], points[ids[at[-1:]]])[:, 0])
            self.ids = ids[np.sort(at)]
            rest = np.setdiff1d(ids, self.ids)
            d2 = squared(points[rest], points[self.ids])
            own, d = d2.argmin(1), np.sqrt(d2)
            for j in range(len(self.ids)):
                if (own == j).any():
                    mine = d[own == j]
                    self.children.append((j, _down(mine.min(0)), _up(mine.max(0)), _Node(points, rest[own == j])))
        self.points = points[self.ids]


class Gnat:
    """Index over the rows of ``points`` (int64); of equal rows the first."""

    def __init__(self, points: np.ndarray):
        self.size = len(points)
        _, first = np.unique(points, axis=0, return_index=True)
        self.root = _Node(points, np.sort(first)) if len(points) else None
        self.compared = 0                  # query-to-point distances computed

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest point; of equally
        near ones that of the lowest index."""
        best, who = np.full(len(q), _FAR), np.full(len(q), self.size)
        if self.root is not None and len(q):
            self._visit(self.root, q, np.arange(len(q)), best, who)
        return who, best

    def _visit(self, node, q, rows, best, who):
        d2 = squared(q[rows], node.points)
        self.compared += d2.size
        near = d2.argmin(1)                # the first of the least: the lowest id
        d, i = d2[np.arange(len(rows)), near], node.ids[near]
        better = (d < best[rows]) | ((d == best[rows]) & (i < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], i[better]
        if not node.children:
            return
        root = np.sqrt(d2)
        low, high = _down(root), _up(root)
        bounds = [_down(np.maximum(low - hi, lo - high).max(1)) for _, lo, hi, _ in node.children]
        # Each row sees the child of its nearest split first.
        for own in (True, False):
            for bound, (j, _, _, child) in zip(bounds, node.children):
                go = ((near == j) == own) & (bound <= _up(np.sqrt(best[rows])))
                if go.any():
                    self._visit(child, q, rows[go], best, who)
