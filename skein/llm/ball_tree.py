"""Ball tree over sparse integer vectors for exact inner-product search (used inside workers).

A node has the centroid of its vectors and, for each of a number of groups of
dimensions, the radius of its vectors in that group's subspace.  By the
Cauchy-Schwarz inequality no inner product of a query with a vector below the
node exceeds ``query · centroid + sum over groups of |query| * radius``.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 16
OWN_GROUPS, SHARED_GROUPS = 128, 384  # the most frequent dimensions have a group each
SAFE = 1e-9  # relative; sums of some 10^5 doubles are off by far less
SCORE_CELLS = 1 << 21  # queries x entries of a leaf that are multiplied at a time


def dimension_groups(df: np.ndarray) -> np.ndarray:
    """Group of every dimension: one each for the most frequent, the others dealt out by rank."""
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    return np.where(rank < OWN_GROUPS, rank, OWN_GROUPS + rank % SHARED_GROUPS)


def query_lengths(weights: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(group, query): a query's length in the subspace of each group, rounded up."""
    square = np.zeros((int(groups.max()) + 1, len(weights)))
    np.add.at(square, groups, (weights.astype(np.float64) ** 2).T)
    return np.sqrt(square) * (1 + SAFE)


class Vectors:
    """Sparse rows: dimensions ``dims`` and integer ``values`` from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, counts: np.ndarray, dims: np.ndarray, values: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.dims, self.values = dims, values

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows' entries, row number within ``rows`` of each)."""
        counts = self.first[rows + 1] - self.first[rows]
        owner = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[rows], counts)
        return place, owner


class BallTree:
    """Nodes in heap order of creation; ``children`` of a leaf is None and ``rows`` its vectors."""

    def __init__(self, vectors: Vectors, size: int, groups: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        self.size, self.groups = size, groups
        self.width = int(groups.max()) + 1 if size else 1
        self.leaf = leaf
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self._grow(np.arange(len(vectors.first) - 1))

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.rows)
        place, owner = self.vectors.part(rows)
        dims, values = self.vectors.dims[place], self.vectors.values[place].astype(np.float64)
        center = np.bincount(dims, values, self.size) / len(rows)
        # |x - c|^2 in a group is |c|^2 there, plus (x - c)^2 - c^2 for every entry of x
        group = self.groups[dims]
        own = center[dims]
        square = np.bincount(owner * self.width + group, values * (values - 2 * own), len(rows) * self.width)
        scale = np.bincount(owner * self.width + group, values * (values + 2 * own), len(rows) * self.width)
        rest = np.bincount(self.groups, center * center, self.width)
        worst = square.reshape(-1, self.width) + SAFE * scale.reshape(-1, self.width) + rest * (1 + SAFE)
        self.rows.append(rows)
        self.centroids.append(center)
        self.radii.append(np.sqrt(np.maximum(worst.max(0), 0)) * (1 + SAFE))
        self.children.append(None)
        if len(rows) > self.leaf:
            near = self._halves(dims, values, owner, center, len(rows))
            left = self._grow(rows[near])
            self.children[at] = (left, self._grow(rows[~near]))
        return at

    def _halves(self, dims: np.ndarray, values: np.ndarray, owner: np.ndarray, center: np.ndarray, n: int) -> np.ndarray:
        """Which rows are in the half nearer to the row farthest from the center than to the row farthest from that."""

        def dense(row: int) -> np.ndarray:
            return np.bincount(dims[owner == row], values[owner == row], self.size)

        norms = np.bincount(owner, values * values, n)
        one = dense(int((norms - 2 * np.bincount(owner, values * center[dims], n)).argmax()))
        two = dense(int((norms - 2 * np.bincount(owner, values * one[dims], n)).argmax()))
        side = np.bincount(owner, values * (one - two)[dims], n)
        near = np.zeros(n, bool)
        near[np.argsort(side, kind="stable")[n // 2 :]] = True
        return near

    def bounds(self, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(node, query): no score of a vector below the node is larger."""
        near = np.stack(self.centroids) @ weights.T.astype(np.float64)
        return (near + np.stack(self.radii) @ lengths) * (1 + SAFE) + 1

    def search(
        self, weights: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) with the ``k`` best rows of each query among scores of ``least`` or more, ties at the end kept.

        Best first: the node with the greatest bound goes next, for those
        queries only whose k-th score so far doesn't exceed their own bound of
        it.  Scores are exact 64-bit integers, made at the leaves.  ``weights``
        is (query, dimension) and ``lengths`` its ``query_lengths``.
        """
        limit = self.bounds(weights, lengths)
        least = least.copy()
        kept: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(weights)
        queue = [(-float(limit[0].max()), 0, np.arange(len(weights)))]
        while queue:
            _, node, asked = heapq.heappop(queue)
            asked = asked[limit[node, asked] >= least[asked]]
            if not len(asked):
                continue
            if children := self.children[node]:
                for child in children:
                    heapq.heappush(queue, (-float(limit[child, asked].max()), child, asked))
                continue
            rows = self.rows[node]
            rows = rows[self.vectors.first[rows + 1] > self.vectors.first[rows]]
            if not len(rows):
                continue
            place, owner = self.vectors.part(rows)
            dims, values, starts = self.vectors.dims[place], self.vectors.values[place], np.flatnonzero(np.diff(owner, prepend=-1))
            step = max(1, SCORE_CELLS // len(place))
            for some in (asked[i : i + step] for i in range(0, len(asked), step)):
                scores = np.add.reduceat(weights[np.ix_(some, dims)] * values, starts, axis=1)
                hits = scores >= least[some, None]
                for i in np.flatnonzero(hits.any(1)).tolist():
                    q = int(some[i])
                    mine = np.concatenate([kept[q], np.column_stack([rows[hits[i]], scores[i][hits[i]]])])
                    if len(mine) >= k:
                        bar = np.partition(mine[:, 1], -k)[-k]
                        mine = mine[mine[:, 1] >= bar]
                        least[q] = max(least[q], bar)
                    kept[q] = mine
        sizes = [len(m) for m in kept]
        found = np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)
        return np.repeat(np.arange(len(kept)), sizes), found[:, 0], found[:, 1]
