"""Vantage-point trees over fingerprints under (masked) Hamming distance.

A node holds a vantage fingerprint and a radius. Whatever lies within the radius goes inside, the rest
outside, and what lies outside but within ``reach`` of the boundary also goes inside. By the triangle
inequality two fingerprints at most ``reach`` apart then always meet in at least one leaf: if one is
inside, the other is at most ``reach`` beyond the boundary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fingerprints compared directly; below it another vantage point costs more than it saves.
LEAF = 256
# A cut has to save this share of the comparisons, or the node stays a leaf.
_WORTH = 0.95
_VANTAGES = 8
_BLOCK = 1 << 22


def hamming(points: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ point) & mask)


@dataclass
class Node:
    vantage: np.uint64
    radius: int
    inside: Node | int
    outside: Node | int


def best_cut(points: np.ndarray, mask: np.uint64, reach: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage, radius and distances that leave the fewest comparisons, or None if no cut is worth it."""
    n, best = len(points), None
    for i in np.linspace(0, n - 1, min(n, _VANTAGES)).astype(int):
        distance = hamming(points, points[i], mask)
        upto = np.cumsum(np.bincount(distance, minlength=65 + reach))
        inside = upto[reach:].astype(float)
        outside = n - upto[: len(inside)].astype(float)
        cost = inside**2 + outside**2
        radius = int(np.argmin(cost))
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], points[i], radius, distance)
    if best is None or best[0] >= _WORTH * n * n:
        return None
    return best[1], best[2], best[3]


def build(sample: np.ndarray, mask: np.uint64, reach: int, leaf_size: float) -> tuple[Node | int, int]:
    """A tree whose leaves are numbered shards of about ``leaf_size`` sample points; and their number."""
    count = 0

    def grow(points: np.ndarray) -> Node | int:
        nonlocal count
        cut = best_cut(points, mask, reach) if len(points) > leaf_size else None
        if cut is None:
            count += 1
            return count - 1
        vantage, radius, distance = cut
        return Node(vantage, radius, grow(points[distance <= radius + reach]), grow(points[distance > radius]))

    return grow(sample), count


def route(tree: Node | int, points: np.ndarray, mask: np.uint64, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards and positions: each point once for every shard it belongs to or borders on."""
    shards, places = [], []

    def descend(node: Node | int, at: np.ndarray) -> None:
        if len(at) == 0:
            return
        if isinstance(node, int):
            shards.append(np.full(len(at), node, np.int32))
            places.append(at)
            return
        distance = hamming(points[at], node.vantage, mask)
        descend(node.inside, at[distance <= node.radius + reach])
        descend(node.outside, at[distance > node.radius])

    descend(tree, np.arange(len(points)))
    return np.concatenate([*shards, np.zeros(0, np.int32)]), np.concatenate([*places, np.zeros(0, np.int64)])


class Forest:
    """Union-find over positions; only the links that join two groups are kept."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        """The smallest position of each one's group."""
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return self.parent
            self.parent = above

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            roots = self.roots()
            a, b = roots[left], roots[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _compare(points: np.ndarray, at: np.ndarray, limit: int, full: np.uint64, forest: Forest) -> None:
    """Link all pairs of a leaf that are at most ``limit`` apart.

    What is within the limit of a leader is linked to it at once. Members of the largest group so far need
    no comparison with each other, so a huge group of near copies stays cheap.
    """
    if len(at) > 4 * LEAF:
        free = np.ones(len(at), bool)
        for _ in range(_VANTAGES):
            if not free.any():
                break
            leader = int(np.argmax(free))
            near = hamming(points[at], points[at[leader]], full) <= limit
            forest.link(np.full(int(near.sum()), at[leader]), at[near])
            free &= ~near
            free[leader] = False
    roots = forest.roots()[at]
    values, counts = np.unique(roots, return_counts=True)
    rows = at[roots != values[np.argmax(counts)]] if counts.max() > 1 else at
    step = max(1, _BLOCK // max(1, len(at)))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        near = np.bitwise_count(points[part][:, None] ^ points[at][None, :]) <= limit
        r, c = np.nonzero(near)
        forest.link(part[r], at[c])


def link_shard(points: np.ndarray, mask: np.uint64, reach: int, limit: int) -> np.ndarray:
    """For every point of a shard the position of its group's first member.

    All pairs within ``limit`` that are within ``reach`` on the masked bits end in one group; a tree built
    on the spot prunes the comparisons.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    forest = Forest(len(points))
    pending = [np.arange(len(points))]
    while pending:
        at = pending.pop()
        cut = best_cut(points[at], mask, reach) if len(at) > LEAF else None
        if cut is None:
            if len(at) > 1:
                _compare(points, at, limit, full, forest)
            continue
        _, radius, distance = cut
        pending += [at[distance <= radius + reach], at[distance > radius]]
    return forest.roots()
