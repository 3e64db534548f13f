"""Metric trees by the anchors hierarchy, and nearest entries by shrinking candidates.

A tree is built from the middle: about sqrt(n) anchors are placed, each at the point
farthest from the anchors before it, and take over the points that are nearer to them;
lists sorted by distance tell which points need not be looked at. Anchors that still hold
many points are split the same way, and anchors merge upwards by the least enclosing
ball. Every ball caches how many points it holds and their sum.

To find each point's nearest entry, candidates are handed down the tree. An entry leaves
the list of a ball when another is nearer to every place in it. Once one is left, the
whole ball is its own, and the cached numbers stand for the points.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 64  # points that a ball holds without being split


def node_type(width: int) -> np.dtype:
    """A ball: the places ``lo`` to ``hi`` of the tree's order, children (-1: none), extent, cached sums."""
    return np.dtype(
        [("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("centre", "<f8", (width,)), ("sums", "<i8", (width,))]
    )


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=-1))


def anchor_groups(points: np.ndarray) -> list[np.ndarray]:
    """The points of each of about sqrt(n) anchors; one group if all are equal."""
    wanted = int(np.ceil(np.sqrt(len(points))))
    far = _distances(points, points[0])
    order = np.argsort(-far, kind="stable")
    lists, reach = [order], [far[order]]
    pivots = np.empty((wanted, points.shape[1]))
    radii = np.zeros(wanted)
    pivots[0], radii[0] = points[0], reach[0][0]
    while len(lists) < wanted:
        n = len(lists)
        widest = int(radii[:n].argmax())
        if radii[widest] == 0:
            break
        new = points[lists[widest][0]]
        half = _distances(pivots[:n], new) / 2
        taken, gaps = [], []
        for a in np.flatnonzero(radii[:n] > half):
            # points within half the way to the new anchor cannot be nearer to it
            m = int(np.searchsorted(-reach[a], -half[a], side="left"))
            gap = _distances(points[lists[a][:m]], new)
            moves = gap < reach[a][:m]
            if moves.any():
                taken.append(lists[a][:m][moves])
                gaps.append(gap[moves])
                stays = np.ones(len(lists[a]), bool)
                stays[:m] = ~moves
                lists[a], reach[a] = lists[a][stays], reach[a][stays]
                radii[a] = reach[a][0] if len(reach[a]) else 0
        found, gap = np.concatenate(taken), np.concatenate(gaps)
        order = np.argsort(-gap, kind="stable")
        lists.append(found[order])
        reach.append(gap[order])
        pivots[n], radii[n] = new, gap[order][0]
    return [x for x in lists if len(x)]


class _Builder:
    def __init__(self, points: np.ndarray):
        self.points = points
        self.real = points.astype(np.float64)
        self.centre, self.radius, self.sums, self.count, self.children, self.members = [], [], [], [], [], []

    def _ball(self, centre, radius, sums, count, children, members) -> int:
        for name, value in zip(("centre", "radius", "sums", "count", "children", "members"), (centre, radius, sums, count, children, members)):
            getattr(self, name).append(value)
        return len(self.count) - 1

    def build(self, members: np.ndarray) -> int:
        """A ball over the points, split until small; depth is logarithmic, as groups shrink to about a root."""
        inside = self.real[members]
        groups = anchor_groups(inside) if len(members) > LEAF else []
        if len(groups) < 2:
            sums = self.points[members].sum(axis=0, dtype=np.int64)
            centre = sums / len(members)
            return self._ball(centre, _distances(inside, centre).max(), sums, len(members), None, members)
        return self._merged([self.build(members[g]) for g in groups])

    def _enclosing(self, a: int, b: int) -> tuple[float, np.ndarray]:
        centre = (self.sums[a] + self.sums[b]) / (self.count[a] + self.count[b])
        return max(_distances(self.centre[x], centre) + self.radius[x] for x in (a, b)), centre

    def _merged(self, balls: list[int]) -> int:
        """One ball over all, always joining the two with the least enclosing ball."""
        alive = set(balls)
        heap = [(self._enclosing(a, b)[0], a, b) for i, a in enumerate(balls) for b in self._nearest(a, balls[i + 1 :])]
        heapq.heapify(heap)
        while len(alive) > 1:
            while heap and not (heap[0][1] in alive and heap[0][2] in alive):
                heapq.heappop(heap)
            if not heap:
                rest = sorted(alive)
                heap = [(self._enclosing(a, b)[0], a, b) for i, a in enumerate(rest) for b in self._nearest(a, rest[i + 1 :])]
                heapq.heapify(heap)
            _, a, b = heapq.heappop(heap)
            radius, centre = self._enclosing(a, b)
            new = self._ball(centre, radius, self.sums[a] + self.sums[b], self.count[a] + self.count[b], (a, b), None)
            alive -= {a, b}
            for other in self._nearest(new, sorted(alive)):
                heapq.heappush(heap, (self._enclosing(new, other)[0], new, other))
            alive.add(new)
        return alive.pop()

    def _nearest(self, ball: int, others: list[int], most: int = 8) -> list[int]:
        """The few others whose balls are nearest, as only those can be the best to join."""
        if len(others) <= most:
            return others
        gap = _distances(np.array([self.centre[o] for o in others]), self.centre[ball]) + np.array([self.radius[o] for o in others])
        return [others[i] for i in np.argpartition(gap, most)[:most]]


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` of the points and the balls as :func:`node_type`, the root first."""
    made = _Builder(points)
    root = made.build(np.arange(len(points)))
    nodes = np.zeros(len(made.count), node_type(points.shape[1]))
    order: list[np.ndarray] = []
    place = {}
    at = 0
    stack = [(root, False)]
    turn: list[int] = []
    while stack:
        ball, done = stack.pop()
        if done:
            left, right = made.children[ball]
            nodes[place[ball]]["hi"] = nodes[place[right]]["hi"]
            continue
        place[ball] = len(turn)
        turn.append(ball)
        node = nodes[place[ball]]
        node["lo"], node["left"], node["right"] = at, -1, -1
        node["radius"], node["centre"], node["sums"] = made.radius[ball], made.centre[ball], made.sums[ball]
        if made.children[ball] is None:
            order.append(made.members[ball])
            at += len(made.members[ball])
            node["hi"] = at
        else:
            left, right = made.children[ball]
            stack += [(ball, True), (right, False), (left, False)]
    for ball in turn:
        if made.children[ball] is not None:
            nodes[place[ball]]["left"], nodes[place[ball]]["right"] = (place[c] for c in made.children[ball])
    return np.concatenate(order).astype(np.int32), nodes


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's nearest entry (ties to the lower index), and per entry how many
    points it got and their sums."""
    k = len(entries)
    real = entries.astype(np.float64)
    apart = _distances(real[:, None, :], real[None])
    code = np.empty(len(points), np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64)
    # an entry equal to one before it never gets a point
    once = np.zeros(k, bool)
    once[np.unique(entries, axis=0, return_index=True)[1]] = True
    front, able = np.zeros(1, np.int64), once[None, :]
    while len(front):
        ball = nodes[front]
        gap = ((ball["centre"][:, None, :] - real[None]) ** 2).sum(axis=-1)
        best = np.where(able, gap, np.inf).argmin(axis=1)
        least = gap[np.arange(len(front)), best][:, None]
        # by how much the best entry is nearer, wherever in the ball; rounding is allowed for
        lead = gap - least - 2 * ball["radius"][:, None] * apart[best]
        able = able & (lead <= 1e-9 * (gap + least) + 1e-6)
        able[np.arange(len(front)), best] = True
        alone = able.sum(axis=1) == 1
        for node, entry in zip(ball[alone], best[alone]):
            code[order[node["lo"] : node["hi"]]] = entry
        np.add.at(counts, best[alone], (ball["hi"] - ball["lo"])[alone])
        np.add.at(sums, best[alone], ball["sums"][alone])
        leaf = ~alone & (ball["left"] < 0)
        for node, list_ in zip(ball[leaf], able[leaf]):
            inside = order[node["lo"] : node["hi"]]
            left = np.flatnonzero(list_)
            near = ((points[inside][:, None, :] - entries[left][None]) ** 2).sum(axis=-1).argmin(axis=1)
            code[inside] = left[near]
            np.add.at(counts, left[near], 1)
            np.add.at(sums, left[near], points[inside])
        inner = ~alone & ~leaf
        front = np.concatenate([ball["left"][inner], ball["right"][inner]]).astype(np.int64)
        able = np.concatenate([able[inner], able[inner]])
    return code, counts, sums
