"""A k-d tree over points in space, in arrays, that answers many queries at once."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and queries that are answered at a time.
LEAF, QUERIES = 32, 2048


class KdTree:
    """Points halved along their widest side until leaves are small; each level's boxes are two arrays."""

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        order, cuts = np.arange(n), np.array([0, n])
        self.low, self.high = [], []
        for level in range(depth + 1):
            own = points[order]
            self.low.append(np.minimum.reduceat(own, cuts[:-1]) if n else np.zeros((1, 3)))
            self.high.append(np.maximum.reduceat(own, cuts[:-1]) if n else np.zeros((1, 3)))
            if level == depth:
                break
            side = (self.high[-1] - self.low[-1]).argmax(axis=1)
            halves = [0]
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(points[order[a:b], side[k]], middle)]
                halves += [a + middle, b]
            cuts = np.array(halves)
        self.order, self.cuts = order, cuts

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """The number of the nearest point of each query; of equally near ones the least. There is at least one point."""
        parts = [self._nearest(queries[i : i + QUERIES]) for i in range(0, len(queries), QUERIES)]
        return np.concatenate(parts) if parts else np.zeros(0, "i8")

    def _nearest(self, q: np.ndarray) -> np.ndarray:
        who, node, most = np.arange(len(q)), np.zeros(len(q), "i8"), np.full(len(q), np.inf)
        for level, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            if level:
                who, node = np.repeat(who, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            x = q[who]
            gap = np.maximum(np.maximum(low[node] - x, x - high[node]), 0)
            far = np.maximum(np.abs(x - low[node]), np.abs(high[node] - x))
            np.minimum.at(most, who, (far * far).sum(axis=1))
            fine = (gap * gap).sum(axis=1) <= most[who] * (1 + 1e-12)
            who, node = who[fine], node[fine]
        size = self.cuts[node + 1] - self.cuts[node]
        at = np.arange(size.sum()) + np.repeat(self.cuts[node] - (np.cumsum(size) - size), size)
        who, number = np.repeat(who, size), self.order[at]
        d = ((q[who] - self.points[number]) ** 2).sum(axis=1)
        first = np.lexsort((number, d, who))
        who, number = who[first], number[first]
        return number[np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))]
