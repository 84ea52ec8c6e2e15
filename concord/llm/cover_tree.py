"""A cover tree over unit vectors in arrays, and the traversal of two trees at once."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np

LEAF = 64
SLICE = 1024


@dataclass
class CoverTree:
    """Points in tree order: every node is a range of them. A node has a centre (one of its points), the covering
    radius (largest distance of a point of the node to it) and children, whose radii are at most half the level's."""

    points: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    ranges: np.ndarray
    children: list[list[int]]

    def packed(self) -> bytes:
        return pickle.dumps((self.points, self.ids, self.weights, self.centres, self.radii, self.ranges, self.children), protocol=5)

    @staticmethod
    def unpacked(data: bytes) -> CoverTree:
        return CoverTree(*pickle.loads(data))


def _nested(points: np.ndarray, at: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """Children of a node: centres more than `radius` apart, its own first, and the points each covers."""
    left, out = at, []
    while len(left):
        far = np.sqrt(np.maximum(2 - 2 * (points[left] @ points[centre]), 0)) > radius
        far[left == centre] = False
        out.append((centre, left[~far]))
        left = left[far]
        if len(out) > LEAF and len(out) > len(at) // 4:
            break  # no structure at this level: the node stays a leaf
        centre = left[0] if len(left) else centre
    return out if not len(left) else []


def build(points: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> CoverTree:
    """A tree of all points; radii halve from level to level."""
    order: list[np.ndarray] = []
    centres, radii, ranges, children = [], [], [], []
    placed = 0

    def add(at: np.ndarray, centre: int, level: float) -> int:
        nonlocal placed
        me = len(centres)
        distance = np.sqrt(np.maximum(2 - 2 * (points[at] @ points[centre]), 0))
        centres.append(centre)
        radii.append(float(distance.max()) + 1e-7)
        ranges.append([placed, placed + len(at)])
        children.append([])
        parts: list[tuple[int, np.ndarray]] = []
        while len(at) > LEAF and level > 1e-4:
            level /= 2
            parts = _nested(points, at, centre, level)
            if len(parts) != 1:
                break
        if len(parts) > 1:
            children[me] = [add(own, c, level) for c, own in parts]
        else:
            order.append(at)
            placed += len(at)
        return me

    mean = points.mean(axis=0)
    add(np.arange(len(points)), int(np.argmax(points @ mean)), 2.0)
    at = np.concatenate(order)
    return CoverTree(points[at], ids[at], weights[at], points[centres], np.array(radii), np.array(ranges), children)


def meet(one: CoverTree, two: CoverTree, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links (cosine at least `least`) between two trees, or within one: summed weights of partners for the points of
    `one` and of `two`, and a forest of links between ids.

    Pairs of nodes go down together; a pair goes no further when its centres are farther apart than the radii and the
    distance that belongs to `least`. Leaves are compared by products of matrices in double precision.
    """
    reach = np.sqrt(2 - 2 * least) + 1e-6
    first, second = np.zeros(len(one.ids), np.int64), np.zeros(len(two.ids), np.int64)
    ids = np.concatenate([one.ids, two.ids])
    shift = 0 if same else len(one.ids)
    group = np.arange(len(ids))
    forest: list[tuple[int, int]] = []
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        gap = np.sqrt(max(2 - 2 * float(one.centres[a] @ two.centres[b]), 0))
        if gap > reach + one.radii[a] + two.radii[b]:
            continue
        if one.children[a] or two.children[b]:
            if same and a == b:
                own = one.children[a]
                stack += [(x, y) for k, x in enumerate(own) for y in own[k:]]
            elif one.children[a] and (not two.children[b] or one.radii[a] >= two.radii[b]):
                stack += [(x, b) for x in one.children[a]]
            else:
                stack += [(a, y) for y in two.children[b]]
            continue
        (a0, a1), (b0, b1) = one.ranges[a], two.ranges[b]
        for lo in range(a0, a1, SLICE):
            hi = min(lo + SLICE, a1)
            near = one.points[lo:hi] @ two.points[b0:b1].T >= least
            if same and a == b:
                near &= np.arange(lo, hi)[:, None] < np.arange(b0, b1)[None, :]
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            first[lo:hi] += near @ two.weights[b0:b1]
            second[b0:b1] += one.weights[lo:hi] @ near
            for r in rows:
                me, partners = lo + r, shift + b0 + np.flatnonzero(near[r])
                groups, at = np.unique(group[partners], return_index=True)
                new = groups != group[me]
                if new.any():
                    forest += [(int(ids[me]), int(ids[partners[k]])) for k in at[new]]
                    group[np.isin(group, groups)] = group[me]
    return first, second, forest
