"""Bin completion: fill fixed-capacity containers around the largest remaining item, by branch and bound.

At each node the largest item opens a container, and its fillings are tried one after the other: first the ``WIDTH`` likeliest (a greedy head,
then a single item, an exact pair or an exact triple for each level of waste), then every undominated one, lazily. A filling is dominated, and
skipped, if an item that is left fits into its gap, or fits in the place of a smaller one of its items. A branch is cut when the waste so far
rules out beating the incumbent, and fillings that would waste more than that are not built. The search ends when the incumbent meets the
lower bound (total size, or Martello and Toth's over all thresholds), when every branch is done, which proves the result the best, or when
``nodes`` steps are spent; ``nodes=None`` sets no limit, so the result is exact. Best fit on decreasing sizes gives the first incumbent, so
every result is whole and valid whatever the limit.

The sizes still available are the bits of one integer, so the best single item and the best pair for a gap are a few word operations.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np

NODES = 1000
DONE: tuple = ("done",)
WIDTH = 2
FIRST = 12


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: over all thresholds k, items above ``capacity - k`` share with nothing of size k or more."""
    most = -(-sum(sizes) // capacity)
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    below, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(len(n)))])
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = below[capacity + 1] - below[capacity - k + 1]
    large, large_mass = below[capacity - k + 1] - below[half + 1], mass[capacity - k + 1] - mass[half + 1]
    small_mass = mass[half + 1] - mass[k]
    more = np.maximum(0, -(-(small_mass - (large * capacity - large_mass)) // capacity))
    return max(most, int((alone + large + more).max()))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by container; each item goes where it leaves the least space."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(gaps, (sizes[i], -1))
        if at == len(gaps):
            bins.append([i])
            insort(gaps, (capacity - sizes[i], len(bins) - 1))
        else:
            gap, b = gaps.pop(at)
            bins[b].append(i)
            insort(gaps, (gap - sizes[i], b))
    return bins


class _Search:
    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.have = 0  # bit s: an item of size s is left
        self.back = 0  # bit capacity - s
        for s in self.count:
            self.have |= 1 << s
            self.back |= 1 << (capacity - s)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.have ^= 1 << s
            self.back ^= 1 << (self.capacity - s)

    def put(self, s: int) -> None:
        if not self.count[s]:
            self.have |= 1 << s
            self.back |= 1 << (self.capacity - s)
        self.count[s] += 1

    def single(self, gap: int) -> int:
        return (self.have & ((1 << (gap + 1)) - 1)).bit_length() - 1

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two items that fill ``gap`` exactly, the larger as large as possible."""
        if gap < 2:
            return None
        both = self.have & (self.back >> (self.capacity - gap)) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            b = gap - a
            if a < b:
                return None
            if a != b or self.count[a] > 1:
                return a, b
            both ^= 1 << a
        return None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three items that fill ``gap`` exactly, the first among the largest that fit."""
        a = self.single(gap - 2) if gap > 2 else -1
        for _ in range(FIRST):
            if a <= 0:
                return None
            self.take(a)
            rest = self.pair(gap - a)
            self.put(a)
            if rest:
                return (a, *rest)
            a = self.single(a - 1)
        return None

    def completions(self, gap: int, most: int) -> list[tuple[int, ...]]:
        """Up to ``most`` undominated fillings of ``gap``, least waste first."""
        head: list[int] = []
        while gap:  # far from full: take the largest items, the end game decides
            a = self.single(gap)
            if a <= 0 or gap <= 3 * a:
                break
            head.append(a)
            self.take(a)
            gap -= a
        found: list[tuple[int, ...]] = []
        one = self.single(gap) if gap else 0
        least = gap - max(one, 0)  # waste of the best single item: what any larger set has to beat
        for waste in range(least + 1):
            goal = gap - waste
            if not goal:
                found.append(tuple(head))
            elif waste == least:
                found.append((*head, one))
            elif two := self.pair(goal):
                found.append((*head, *two))
            elif three := self.triple(goal):
                found.append((*head, *three))
            if len(found) >= most:
                break
        for a in head:
            self.put(a)
        return found or [tuple(head)]


    def fillings(self, first: int, waste: int) -> Iterator[tuple[int, ...] | None]:
        """All undominated fillings around ``first`` that waste at most ``waste``, taking large items first; None is a step without one."""
        gap = self.capacity - first
        count = {s: n - (s == first) for s, n in self.count.items() if n > (s == first) and s <= gap}
        sizes = sorted(count, reverse=True)
        below = [0]  # what the items from a place on hold
        for s in reversed(sizes):
            below.append(below[-1] + s * count[s])
        below.reverse()
        negative = [-s for s in sizes]
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, gap, ())]
        while stack:
            i, left, chosen = stack.pop()
            i = max(i, bisect_left(negative, -left))
            while i < len(sizes) and chosen and chosen[-1] == sizes[i] and chosen.count(sizes[i]) == count[sizes[i]]:
                i += 1
            if left - below[i] > waste:
                yield None
            elif i == len(sizes):
                yield None if self._dominated(chosen, left, count, sizes, negative) else chosen
            else:
                stack.append((i + 1, left, chosen))
                stack.append((i, left - sizes[i], (*chosen, sizes[i])))
                yield None

    @staticmethod
    def _dominated(chosen: tuple[int, ...], left: int, count: dict[int, int], sizes: list[int], negative: list[int]) -> bool:
        for s in (0, *set(chosen)):  # an item left that fits the gap, or the place of a smaller one with it
            for x in sizes[bisect_left(negative, -(s + left)) : bisect_left(negative, -s)]:
                if chosen.count(x) < count[x]:
                    return True
        return False


def complete(sizes: list[int], capacity: int, nodes: int | None = NODES) -> list[list[int]]:
    """Sizes by container, by bin completion; ``sizes`` are between 1 and ``capacity``."""
    total = sum(sizes)
    bound = lower_bound(sizes, capacity)
    best = [[sizes[i] for i in b] for b in best_fit_decreasing(sizes, capacity)]
    if len(best) <= bound:
        return best
    search = _Search(sizes, capacity)
    trail: list[tuple[int, tuple[int, ...]]] = []
    options: list[Iterator[tuple[int, ...] | None]] = []
    waste, left, spent = 0, len(sizes), 0

    def undo() -> None:
        nonlocal waste, left
        first, rest = trail.pop()
        for s in (first, *rest):
            search.put(s)
        left += 1 + len(rest)
        waste -= capacity - first - sum(rest)

    while True:
        if not left:
            best = [[first, *rest] for first, rest in trail]
            if len(best) <= bound:
                return best
        slack = (len(best) - 1) * capacity - total
        if left and waste <= slack and len(trail) < len(best) - 1:
            first = search.have.bit_length() - 1
            search.take(first)
            likely = search.completions(capacity - first, WIDTH)
            search.put(first)
            options.append(chain(likely, search.fillings(first, slack - waste)))
        else:
            if not trail:
                return best
            undo()
        rest = None
        while rest is None:
            spent += 1
            if nodes is not None and spent > nodes + len(best):
                return best
            rest = next(options[-1], DONE)
            if rest is DONE:
                options.pop()
                if not trail:
                    return best
                undo()
                rest = None
        first = search.have.bit_length() - 1
        for s in (first, *rest):
            search.take(s)
        trail.append((first, rest))
        left -= 1 + len(rest)
        waste += capacity - first - sum(rest)


def pack(sizes: list[int], capacity: int, nodes: int | None = NODES) -> list[list[int]]:
    """Positions of ``sizes`` by container."""
    at: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        at.setdefault(sizes[i], []).append(i)
    return [[at[s].pop() for s in b] for b in complete(sizes, capacity, nodes)] if sizes else []
