"""Numeric steps that run inside Spark tasks on one bounded group or batch."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def starts_of(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row positions where a new key begins in a frame sorted by ``keys``."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup sorted batches so that no key is cut: frames and their group starts.

    One call handles many small groups, which a call per group would not.
    """
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        starts = starts_of(pdf, keys)
        if rest and len(starts) == 1 and all(pdf[k].iat[0] == rest[-1][k].iat[-1] for k in keys):
            rest.append(pdf)  # a long group is put together once, at its end
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True)
        starts = starts_of(pdf, keys)
        done, rest = pdf.iloc[: starts[-1]], [pdf.iloc[starts[-1] :]]
        if len(done):
            yield done, starts[:-1]
    if rest:
        yield pd.concat(rest, ignore_index=True), np.array([0])


# How far a node's next round depends on nodes beside it, at most.
_SIGHT = 5


def merge_rounds(
    t: np.ndarray, copies: np.ndarray, max_gap: int, open_left: bool = False, open_right: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Synchronous merging of mutually nearest times.

    ``t`` ascending and distinct, ``copies`` rows per time. Returns the final
    group number and centre of each time, and whether they are sure.

    At an open end there are more times that are not given. What may depend on them
    spreads inwards by a few nodes a round, and ends for good where two nodes are
    ``max_gap`` apart: neither can come nearer to the other any more. Only what it has
    reached by then is not sure, whole groups at a time.

    A time held by several rows always merges with itself first: a gap of zero
    beats every other, from either side. So rows of one time stay together and
    only how many rows a time has must be remembered.

    A round only looks at nodes near those that the round before has changed: a
    pair further off would have met then. So the work follows the merges and not
    rounds times nodes.
    """
    n = len(t)
    at, size = t.tolist(), copies.tolist()
    total = [a * k for a, k in zip(at, size)]
    rows = list(size)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    joined = list(range(n))  # the node that a node went into

    def gap(i: int) -> float:
        return at[right[i]] - at[i] if right[i] >= 0 else np.inf

    def ahead(i: int) -> bool:
        j = right[i]
        if j < 0 or rows[i] > 1 or rows[j] > 1:
            return False
        step = at[j] - at[i]
        return step < max_gap and step <= gap(j) and (left[i] < 0 or step <= at[i] - at[left[i]])

    def absorb(i: int) -> None:
        """Puts the right neighbour of ``i`` into it."""
        j = right[i]
        joined[j] = i
        total[i] += total[j]
        size[i] += size[j]
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i

    # the unsure nodes at each end; a side is done once a wide gap has been met
    unsure: list[set[int]] = [set(), set()]
    going = [open_left and n > 0, open_right and n > 0]
    step = (right, left)
    first = [0, n - 1]  # the next node that may become unsure

    def spread(side: int, most: int) -> None:
        for _ in range(most):
            i = first[side]
            if i < 0:
                going[side] = False
            if not going[side]:
                return
            unsure[side].add(i)
            j = step[side][i]
            if j >= 0 and abs(at[j] - at[i]) >= max_gap:
                going[side] = False
                return
            first[side] = j

    changed = set(range(n))
    while changed:
        for side in (0, 1):
            spread(side, _SIGHT)
        near = set()
        for i in changed:
            for _ in range(4):
                if i < 0:
                    break
                near.add(i)
                i = left[i]
        near.update(right[i] for i in changed if right[i] >= 0)
        meets = [i for i in near if ahead(i) and not ahead(right[i])]
        moved = {i for i in changed if rows[i] > 1}
        for i in moved:
            rows[i] = 1
        for i in meets:
            j = right[i]
            if first[0] == j:  # i is unsure, and now holds what came next
                first[0] = right[j]
            if j in unsure[1]:
                unsure[1].add(i)
                if first[1] == i:
                    first[1] = left[i]
            elif first[1] == j:
                first[1] = i
            absorb(i)
            at[i] = total[i] // size[i]
        changed = moved.union(meets)
        # neighbours with equal centres share a node from here on
        for i in sorted(changed):
            if joined[i] != i:
                continue
            while left[i] >= 0 and at[left[i]] == at[i]:
                i = left[i]
            while right[i] >= 0 and at[right[i]] == at[i]:
                rows[i] += 1
                for side in (0, 1):
                    if right[i] in unsure[side]:
                        unsure[side].add(i)
                    if first[side] == right[i]:
                        first[side] = i
                absorb(i)
                changed.add(i)
        changed = {i for i in changed if joined[i] == i}
    for side in (0, 1):
        spread(side, n)
    group = np.arange(n)
    for i in range(n):  # nodes go into nodes before them
        group[i] = i if joined[i] == i else group[joined[i]]
    sure = np.array([not (i in unsure[0] or i in unsure[1]) for i in range(n)], bool)
    return group, np.array([at[i] for i in group.tolist()], dtype=np.int64), sure[group]


def hull_of(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise from the lowest (x, y).

    Points closer than ``tol`` (twice the triangle area) to a hull edge are left
    out, so collinear points give their two ends.
    """
    order = np.lexsort((y, x))
    order = [i for k, i in enumerate(order) if k == 0 or (x[i], y[i]) != (x[order[k - 1]], y[order[k - 1]])]
    if len(order) < 3:
        return np.array(order, dtype=int)

    def chain(seq):
        out = []
        for i in seq:
            while len(out) > 1:
                o, a = out[-2], out[-1]
                cross = (x[a] - x[o]) * (y[i] - y[o]) - (y[a] - y[o]) * (x[i] - x[o])
                if cross > tol:
                    break
                out.pop()
            out.append(i)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1], dtype=int)


def maybe_corners(x: np.ndarray, y: np.ndarray, starts: np.ndarray, tol: float) -> np.ndarray:
    """Which points may be hull corners of their group: all but those strictly inside the
    octagon of its outermost points in eight directions, for all groups at once."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    ends = []
    for u, v in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)):
        reach = u * x + v * y
        top = np.flatnonzero(reach == np.maximum.reduceat(reach, starts)[group])
        end = starts.copy()
        end[group[top]] = top
        ends.append(end)
    # left of every side of a closed chain is inside, whatever the chain; sides of one point say nothing
    inside, sides = np.ones(len(x), bool), np.zeros(len(starts), bool)
    for a, b in zip(ends, [*ends[1:], ends[0]]):
        ax, ay, dx, dy = x[a], y[a], x[b] - x[a], y[b] - y[a]
        side = (dx != 0) | (dy != 0)
        sides |= side
        inside &= ~side[group] | (dx[group] * (y - ay[group]) - dy[group] * (x - ax[group]) > tol)
    return ~(inside & sides[group])


def kernel_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, gx: np.ndarray, gy: np.ndarray, hx: float, hy: float) -> np.ndarray:
    """Weighted product-kernel sums of a batch on a grid: one matrix product."""
    kx = np.exp(-0.5 * ((gx[None, :] - x[:, None]) / hx) ** 2)
    ky = np.exp(-0.5 * ((gy[None, :] - y[:, None]) / hy) ** 2)
    return (kx * weight[:, None]).T @ ky


def reach_back(t: np.ndarray, core: np.ndarray, max_eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Least ``max(core[j], t[i] - t[j])`` over earlier ``j`` within ``max_eps``, and the
    first ``j`` that gives it (``i`` itself where there is none).

    ``t`` ascending; NaN in ``core`` marks no core. Looking back stops once the
    gap alone is worse than what was found.
    """
    out, source = np.full(len(t), np.nan), np.arange(len(t))
    for i in range(1, len(t)):
        best = np.inf
        for j in range(i - 1, -1, -1):
            gap = t[i] - t[j]
            if gap > max_eps or gap > best:
                break
            if core[j] == core[j] and max(core[j], gap) <= best:
                best, source[i] = max(core[j], gap), j
        if best < np.inf:
            out[i] = best
    return out, source


# A point of the reachability plot: its second, which of that second's rows it is, its
# place among all rows, the reachability (infinite if none), the second that gave it, and
# how many rows it stands for.
PLOT_POINT = np.dtype(
    [("t", "<i8"), ("copy", "<i8"), ("at", "<i8"), ("reach", "<f8"), ("source", "<f8"), ("weight", "<i8")]
)


def plot_points(t: np.ndarray, rows: np.ndarray, core: np.ndarray, reach: np.ndarray, source: np.ndarray, *, most: int) -> np.ndarray:
    """The plot of one period. Of a second with more than ``most`` rows the middle ones
    are left out; they lie between equal values.

    The first row of a second is reached from an earlier second; the others from that one
    too, or from the first row if that is nearer.
    """
    kept = np.minimum(rows, most)
    begin = np.repeat(np.cumsum(kept) - kept, kept)
    copy = np.arange(int(kept.sum())) - begin
    second = np.repeat(np.arange(len(t)), kept)
    last = copy == kept[second] - 1
    points = np.zeros(len(second), PLOT_POINT)
    points["t"] = t[second]
    points["weight"] = 1
    # rows left out go with the one before them
    thinned = np.flatnonzero(rows > most)
    points["weight"][(np.cumsum(kept) - 2)[thinned]] += (rows - most)[thinned]
    points["copy"] = np.where(last, rows[second] - 1, copy)
    points["at"] = (np.cumsum(rows) - rows)[second] + points["copy"]
    first_reach = np.where(np.isnan(reach), np.inf, reach)[second]
    own = np.where(np.isnan(core), np.inf, core)[second]
    nearer = (copy > 0) & (own < first_reach)
    points["reach"] = np.where(nearer, own, first_reach)
    points["source"] = np.where(nearer, t[second], source[second])
    return points


def steep_clusters(points: np.ndarray, *, xi: float, flat: int, least: int) -> list[tuple[int, int]]:
    """First and last point of each cluster, by place.

    Steep points of one direction form an area while no point between them goes the
    other way and at most ``flat`` points between them are not steep. Areas are taken in
    order; ``open_`` holds the steep-down areas that may still begin a cluster, each
    with the highest value since its end.
    """
    height = np.append(points["reach"], np.inf)
    at = points["at"]
    low = 1 - xi
    now, ahead = height[:-1], height[1:]
    rises, falls = now < ahead, now > ahead
    with np.errstate(divide="ignore", invalid="ignore"):
        share = now / ahead
    steep = {1: rises & (share <= low), -1: falls & (share >= 1 / low)}
    areas = []
    for way, against in ((1, falls), (-1, rises)):
        spots = np.flatnonzero(steep[way])
        if not len(spots):
            continue
        turns = np.cumsum(against)
        joined = (turns[spots[1:]] == turns[spots[:-1]]) & (at[spots[1:]] - at[spots[:-1]] - 1 <= flat)
        heads = np.flatnonzero(np.append(True, ~joined))
        tails = np.append(heads[1:], len(spots)) - 1
        areas += [(int(a), int(b), way) for a, b in zip(spots[heads], spots[tails])]
    areas.sort()

    found: list[tuple[int, int]] = []
    open_: list[list] = []  # first point, last point, highest value since
    done, taken = 0, -1  # first point after the last area; last point of the last cluster
    for first, last, way in areas:
        between = height[done : first + 1].max()
        open_ = [[a, b, max(top, between)] for a, b, top in open_ if between <= height[a] * low and between < np.inf]
        done = last + 1
        if way < 0:
            open_.append([first, last, 0.0])
            continue
        after = height[last + 1]
        for a, b, top in reversed(open_):
            if after * low < top:
                continue
            pair = _cluster(points, height, (a, b), (first, last), low)
            if pair is None or at[pair[1]] - at[pair[0]] + 1 < least:
                continue
            if pair[0] > taken:
                found.append(pair)
                taken = pair[1]
            break  # areas further out only give clusters around this one
    return found


def _cluster(points: np.ndarray, height: np.ndarray, down: tuple[int, int], up: tuple[int, int], low: float) -> tuple[int, int] | None:
    """Ends of the cluster between two areas, set to about one level on either side."""
    start, end = down[0], up[1]
    top, after = height[start], height[end + 1]
    if top * low >= after:
        while start < down[1] and height[start + 1] > after:
            start += 1
    elif after * low >= top:
        while end > up[0] and height[end - 1] > top:
            end -= 1
    # the last point must be reached from inside the cluster, or lie lower than its start
    begun = (points["t"][start], points["copy"][start])
    while end >= up[0]:
        if height[start] > height[end] or (points["source"][end], 0) >= begun:
            return start, end
        end -= 1
    return None


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` numbers' component, for links ``a`` to ``b``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _cell_numbers(cells: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with wide gaps made narrow, and the factors that turn them into one number each."""
    out = np.empty_like(cells)
    spans = []
    for i, r in enumerate(reach.tolist()):
        values, back = np.unique(cells[:, i], return_inverse=True)
        places = np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), r + 1))])
        out[:, i] = places[back] + r
        spans.append(int(places[-1]) + 2 * r + 1)
    factors = [math.prod(spans[i + 1 :]) for i in range(len(spans))]
    return out, np.array(factors, np.int64 if math.prod(spans) < 1 << 62 else object)


def _point_pairs(left: np.ndarray, right: np.ndarray, starts: tuple, counts: tuple, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of points of the pairs of cells, in blocks."""
    size = counts[0][left] * counts[1][right]
    upto = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        part = size[a:b]
        pair = np.repeat(np.arange(a, b), part)
        place = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        wide = counts[1][right[pair]]
        yield starts[0][left[pair]] + place // np.maximum(wide, 1), starts[1][right[pair]] + place % np.maximum(wide, 1)
        a = b


def near_cells(
    cells: np.ndarray, at: np.ndarray, pid: np.ndarray, n: np.ndarray, far: np.ndarray, own: np.ndarray, node: np.ndarray,
    *, axes: list[tuple[list[int], float]], around: np.ndarray, min_samples: int,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The five tables of :func:`amperic.operators.halo.partwise` for one part.

    Points of one cell are neighbours of each other. Whole cells are compared first, by
    their boxes and the points that touch them, and points only where that decides nothing.
    """

    def within(gap: np.ndarray) -> np.ndarray:
        ok = np.ones(gap.shape[:-1], bool)
        for cols, eps in axes:
            if len(cols) == 1:
                ok &= gap[..., cols[0]] <= eps
            else:
                part = gap[..., cols]
                ok &= (part * part).sum(axis=-1) <= eps * eps
        return ok

    none = (np.zeros(0, np.int64),) * 3
    if not len(pid):
        return [none] * 5
    narrow, factors = _cell_numbers(cells, np.abs(around).max(axis=0))
    number = (narrow * factors).sum(axis=1)
    order = np.argsort(number, kind="stable")
    at, pid, n, far, own, node, number = (x[order] for x in (at, pid, n, far, own, node, number))
    start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    codes = number[start]
    count = np.diff(np.append(start, len(pid)))
    mine = np.repeat(np.arange(len(start)), count)
    weight = np.add.reduceat(n, start)
    low, high = np.minimum.reduceat(at, start), np.maximum.reduceat(at, start)
    home, name = own[start], node[start]

    # pairs of an own cell and another cell around it whose boxes are within reach
    lefts, rights = [], []
    inside = np.flatnonzero(home)
    for step in (around * factors).sum(axis=1):
        wanted = codes[inside] + step
        place = np.searchsorted(codes, wanted)
        place[place == len(codes)] = 0
        hit = codes[place] == wanted
        lefts.append(inside[hit])
        rights.append(place[hit])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    ok = within(np.maximum(np.maximum(low[right] - high[left], low[left] - high[right]), 0))
    left, right = left[ok], right[ok]

    # 1: core, 0: not, -1: a halo point of a thin cell, which its own part will tell
    thick = weight >= min_samples
    core = np.ones(len(pid), np.int8)
    if min_samples > 2:
        near = weight[mine] + far
        thin = ~thick[left]
        for a, b in _point_pairs(left[thin], right[thin], (start, start), (count, count)):
            hit = within(np.abs(at[a] - at[b]))
            near += np.bincount(a[hit], weights=n[b[hit]], minlength=len(pid)).astype(np.int64)
        core = np.where(thick[mine] | (own & (near >= min_samples)), 1, np.where(own, 0, -1)).astype(np.int8)

    # the points that a link may rest on
    live = np.flatnonzero(core != 0)
    live_count = np.bincount(mine[live], minlength=len(start))
    live_start = np.cumsum(live_count) - live_count
    sure_count = np.bincount(mine[core == 1], minlength=len(start))
    all_sure = (sure_count == count) & (count > 0)
    a, b = left, right
    ok = (sure_count[a] > 0) & (live_count[b] > 0) & (~home[b] | (a < b))
    a, b = a[ok], b[ok]
    sure = (sure_count[b] > 0) & within(np.maximum(high[b] - low[a], high[a] - low[b]))
    # points that touch their cell's box, an index per axis and side
    ends = []
    for axis in range(at.shape[1]):
        ranked = np.lexsort((at[:, axis], mine))
        ends += [ranked[start], ranked[start + count - 1]]
    ends = np.stack(ends, axis=1)
    many = np.flatnonzero(~sure & all_sure[a] & all_sure[b] & (count[a] * count[b] > ends.shape[1] ** 2))
    for some in np.array_split(many, max(1, len(many) // 20_000)):
        p, q = at[ends[a[some]]][:, :, None, :], at[ends[b[some]]][:, None, :, :]
        sure[some] = within(np.abs(p - q)).any(axis=(1, 2))
    joined = [(a[sure], b[sure])]
    local = home[b] & sure
    root = least_joined(len(start), a[local], b[local])
    rest = ~sure & ~(home[b] & (root[a] == root[b]))
    maybe: list[tuple[np.ndarray, np.ndarray]] = []
    for p, q in _point_pairs(a[rest], b[rest], (live_start, live_start), (live_count, live_count)):
        p, q = live[p], live[q]
        hit = (core[p] == 1) & within(np.abs(at[p] - at[q]))
        p, q = p[hit], q[hit]
        known = core[q] == 1
        joined.append(tuple(np.unique(np.stack([mine[p[known]], mine[q[known]]]), axis=1)))
        maybe.append(tuple(np.unique(np.stack([mine[p[~known]], q[~known]]), axis=1)))
    a, b = (np.concatenate(x) for x in zip(*joined))
    local = home[b]
    root = least_joined(len(start), a[local], b[local])

    def table(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if w is None:
            x, y = np.unique(np.stack([x, y]), axis=1) if len(x) else (x, y)
        return x.astype(np.int64), y.astype(np.int64), (np.zeros(len(x), np.int64) if w is None else w.astype(np.int64))

    told = np.flatnonzero(own & (core == 1))
    stars = np.flatnonzero(root != np.arange(len(start)))
    outer = ~home[b]
    links = (np.concatenate([name[stars], name[root[a[outer]]]]), np.concatenate([name[root[stars]], name[b[outer]]]))
    m, q = (np.concatenate(x) for x in zip(*maybe)) if maybe else none[:2]
    out = [table(pid[told], name[mine[told]], n[told]), table(*links), table(name[root[m]], pid[q])]

    edge = np.flatnonzero(own & (core == 0))
    if not len(edge):
        return [*out, none, none]
    edge_count = np.bincount(mine[edge], minlength=len(start))
    edge_start = np.cumsum(edge_count) - edge_count
    beside = edge[sure_count[mine[edge]] > 0]
    border, unsure = [(pid[beside], name[mine[beside]])], []
    some = (edge_count[left] > 0) & (live_count[right] > 0)
    for p, q in _point_pairs(left[some], right[some], (edge_start, live_start), (edge_count, live_count)):
        p, q = edge[p], live[q]
        hit = within(np.abs(at[p] - at[q]))
        p, q = p[hit], q[hit]
        known = core[q] == 1
        border.append((pid[p[known]], name[mine[q[known]]]))
        unsure.append((pid[p[~known]], pid[q[~known]]))
    return [*out, table(*(np.concatenate(x) for x in zip(*border))), table(*(np.concatenate(x) for x in zip(*unsure))) if unsure else none]
