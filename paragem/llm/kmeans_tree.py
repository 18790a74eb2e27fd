"""A hierarchical k-means tree and its best-bin-first traversal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Children of a node, most sampled vectors in a leaf, rounds of k-means.
BRANCHES, LEAF, ROUNDS = 16, 32, 8


@dataclass(frozen=True)
class Tree:
    """Node k has centre ``centres[k]`` and children ``first[k]`` to ``first[k] + count[k]``; a leaf has none."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector falls into, by the nearest child at every level."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.unique(at[self.count[at] > 0])
            if not len(inner):
                return at
            for node in inner:
                own = np.flatnonzero(at == node)
                children = slice(self.first[node], self.first[node] + self.count[node])
                at[own] = self.first[node] + squared(vectors[own], self.centres[children]).argmin(axis=1)

    @cached_property
    def paths(self) -> np.ndarray:
        """For each of the ``leaves`` the nodes below the root that lead to it, the leaf itself repeated at the end."""
        parent = np.zeros(len(self.count), np.int64)
        for node in np.flatnonzero(self.count):
            parent[self.first[node] : self.first[node] + self.count[node]] = node
        ways = []
        for node in self.leaves.tolist():
            way = [node]
            while parent[way[0]]:
                way.insert(0, parent[way[0]])
            ways.append(way)
        deepest = max(map(len, ways))
        return np.array([way + way[-1:] * (deepest - len(way)) for way in ways])

    def visits(self, queries: np.ndarray, leaves: int, held: np.ndarray, needed: int) -> list[np.ndarray]:
        """Leaves in the order of a queue by distance of centres, at least ``leaves`` and until they hold ``needed``.

        ``held`` has the number of rows below each leaf; leaves without rows are left out. Of two leaves the queue
        brings up that one first whose way from their fork on has the lesser greatest distance. Comparing the
        ways' greatest distances from the first level on, then from the second and so forth, gives the same order.
        """
        paths = self.paths[held[self.leaves] > 0]
        far = squared(queries, self.centres)
        keys = [far[:, paths[:, -1]]]
        for level in range(paths.shape[1] - 2, -1, -1):
            keys.append(np.maximum(far[:, paths[:, level]], keys[-1]))
        order = paths[np.lexsort(keys, axis=-1), -1]
        enough = np.maximum((np.cumsum(held[order], axis=1) < needed).sum(axis=1) + (needed > 0), leaves)
        return [row[:n] for row, n in zip(order, enough.tolist(), strict=True)]

    def best_bins(self, query: np.ndarray, leaves: int, held: np.ndarray, needed: int) -> list[int]:
        """The leaves that one query visits."""
        return self.visits(query[None], leaves, held, needed)[0].tolist()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding; good for ranking only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means from distinct seeds: centres and the centre of each vector."""
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    own = squared(vectors, centres).argmin(1)
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        moved = squared(vectors, centres).argmin(1)
        if np.array_equal(moved, own):
            break
        own = moved
    return centres, own


def build(sample: np.ndarray, seed: int = 0) -> Tree:
    """The tree of a sample of distinct vectors."""
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1] if sample.ndim == 2 else 0
    centres, first, count = [sample.mean(0) if len(sample) else np.zeros(dimension)], [0], [0]
    waiting = [(0, sample)]
    while waiting:
        node, own = waiting.pop()
        if len(own) <= LEAF:
            continue
        k = min(BRANCHES, -(-len(own) // LEAF) + 1)
        middle, of = means(own, k, rng)
        parts = [c for c in range(k) if (of == c).any()]
        if len(parts) < 2:
            continue
        first[node], count[node] = len(centres), len(parts)
        for c in parts:
            waiting.append((len(centres), own[of == c]))
            centres.append(middle[c])
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count))


def calibrated_leaves(tree: Tree, sample: np.ndarray, neighbours: int, target: float, queries: int) -> int:
    """Fewest leaves after which ``queries`` sampled vectors find ``target`` of their true neighbours."""
    if len(sample) < 2:
        return 1
    asked = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
    leaf = tree.leaf_of(sample)
    held = np.bincount(leaf, minlength=len(tree.count))
    far = squared(sample[asked], sample)
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(far, axis=1)[:, : min(neighbours, len(sample) - 1)]
    place = np.empty(near.shape, np.int64)
    for row, q in enumerate(asked):
        order = np.full(len(tree.count), len(tree.count))
        seen = tree.best_bins(sample[q], len(tree.count), held, 0)
        order[seen] = np.arange(len(seen))
        place[row] = order[leaf[near[row]]]
    wanted = max(1, int(np.ceil(target * place.size)))
    return min(int(np.partition(place.ravel(), wanted - 1)[wanted - 1]) + 1, len(tree.leaves))
