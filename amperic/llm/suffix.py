"""Suffix sorting in linear time by Lyndon grouping."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order.

    Symbols are integers; the last one must be smaller than all others. The first
    phase groups suffixes by their longest Lyndon prefix: groups are taken in
    descending order, each member looks up the nearest smaller suffix before it,
    and the groups of those are split, as their prefix now includes the member's.
    A smaller suffix with several such members goes above one with fewer. The
    second phase goes over the groups in ascending order: once a suffix has its
    place, the suffixes that end their Lyndon prefix there are next in theirs, and
    they are found along the same pointers. Nothing is renamed and sorted again.
    """
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    symbols = sorted(by_symbol)
    members = [by_symbol[c] for c in symbols]
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in text]
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = list(range(1, len(members) + 1))
    # the nearest suffix to the left whose group was not taken yet when the member's was
    before = [-2] * n
    order = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        order.append(g)
        members[g] = own
        children: dict[int, int] = {}
        for i in own:
            p = i - 1
            # taken groups know their own pointer, which skips what is larger
            while p >= 0 and before[p] != -2:
                p = before[p]
            before[i] = p
            if p >= 0:
                children[p] = children.get(p, 0) + 1
        if children:
            _split(children, group, members, below, above)
        g = below[g]

    start = [0] * len(members)
    at = 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    start[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = before[s]
    return out


def _split(children: dict[int, int], group: list[int], members: list[list[int]], below: list[int], above: list[int]) -> None:
    """Moves each suffix in ``children`` to a new group right above its present
    one, suffixes with more children higher. Old member lists are not touched: who
    has moved is left out when the group's turn comes."""
    by_count: dict[int, list[int]] = {}
    for p, k in children.items():
        by_count.setdefault(k, []).append(p)
    for k in sorted(by_count, reverse=True):
        moved: dict[int, list[int]] = {}
        for p in by_count[k]:
            moved.setdefault(group[p], []).append(p)
        for c, ps in moved.items():
            new = len(members)
            members.append(ps)
            below.append(c)
            above.append(above[c])
            below[above[c]] = above[c] = new
            for p in ps:
                group[p] = new
