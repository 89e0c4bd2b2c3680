"""Bin packing of a histogram of lengths, after the linear grouping scheme, as runs of equal placements.

The input is how many items there are of each length, so its size is bounded by the capacity, not by the number of items.
A run (length, lo, hi, sequence, offset, each) says: of the items of that length, those with rank lo <= r < hi go, ``each`` at a
time, to the sequences from ``sequence`` on, the first of them at ``offset``. Their number is bounded: a class of bins is cut at most
once for each length, and every visit of best fit leaves under half of its room, so that there are at most 11 visits to
each of about three classes a length of 2048: under 70,000 runs for any number of items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np

Run = tuple[int, int, int, int, int, int]


class Bins:
    """Open bins as classes of equal room with consecutive numbers; filled from the left without gaps."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.runs = capacity, 0, []
        self.taken: dict[int, int] = defaultdict(int)
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n

    def put(self, room: int, base: int, n: int) -> None:
        if n and room:
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((base, n))

    def take(self, room: int) -> tuple[int, int]:
        base, n = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.remove(room)
        return base, n

    def place(self, length: int, n: int, base: int, offset: int, each: int = 1) -> None:
        """The next n items of this length, ``each`` in a bin, into the bins from base on."""
        lo = self.taken[length]
        self.taken[length] += n
        self.runs.append((length, lo, lo + n, base, offset, each))

    def best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                self.put(self.capacity, self.open(k := max(1, n // each)), k)
                continue
            room = self.rooms[at]
            base, bins = self.take(room)
            each = min(room // length, n)
            full = min(bins, n // each)
            self.place(length, full * each, base, self.capacity - room, each)
            self.put(room - each * length, base, full)
            self.put(room, base + full, bins - full)
            n -= full * each


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 4000) -> list[tuple[tuple[int, ...], float]]:
    """Column generation for the fewest bins that hold ``counts`` of few ``sizes``: configurations and how often (fractional)."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(counts, float)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes], float))
    x = inverse @ need
    most = capacity // int(size.min())
    for _ in range(rounds):
        dual = inverse.sum(0)
        value, back = np.zeros(capacity + 1), []
        for _ in range(most):
            best, pick = value.copy(), np.full(capacity + 1, -1)
            for i in np.flatnonzero(dual > 1e-12):
                s = sizes[i]
                other = value[: capacity + 1 - s] + dual[i]
                better = other > best[s:] + 1e-12
                best[s:][better] = other[better]
                pick[s:][better] = i
            back.append(pick)
            if (pick < 0).all():
                break
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(back):
            if (i := pick[room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        way = inverse @ column
        can = np.flatnonzero(way > 1e-9)
        if not len(can):
            break
        leave = can[np.argmin(np.maximum(x[can], 0) / way[can])]
        step = max(x[leave], 0) / way[leave]
        x -= step * way
        x[leave] = step
        row = inverse[leave] / way[leave]
        inverse -= np.outer(way, row)
        inverse[leave] = row
        columns[leave] = column
    return [(tuple(int(v) for v in c), max(0.0, float(n))) for c, n in zip(columns, x)]


def plan(histogram: dict[int, int], capacity: int, *, cuts: tuple[int, ...] = (), groups: int = 400) -> tuple[list[Run], int]:
    """Runs for all items and the number of bins: the fewer of ``grouped_plan`` over two cuts between large and small.

    Rounding costs at most what one group holds, so with hundreds of groups it hardly shows. Above a third of the capacity two
    large items meet in a configuration, above a half one has a bin's configuration for itself and more is left to best fit; which is
    better depends on how much there is of small items, and both take a few seconds at most for any number of items.
    """
    histogram = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    return min((grouped_plan(histogram, capacity, cut, groups) for cut in cuts or (capacity // 3, capacity // 2)), key=lambda x: x[1])


def grouped_plan(histogram: dict[int, int], capacity: int, large: int, groups: int) -> tuple[list[Run], int]:
    """Lengths over ``large`` are cut, longest first, into ``groups`` groups of equal cardinality and rounded up to the
    longest of the group; the few sizes are packed by whole multiples of optimal configurations; the slots of a group
    take its actual items; what the fractions leave, then the small items, goes in best-fit order, longest first."""
    big = [(n, c) for n, c in histogram.items() if n > large]
    per = max(1, -(-sum(c for _, c in big) // groups))
    bins, members, sizes, counts = Bins(capacity), [], [], []
    spare = [[n, c] for n, c in big]
    while spare:
        want, group = per, []
        while want and spare:
            n, c = spare[0]
            use = min(want, c)
            group.append([n, use])
            want -= use
            spare[0][1] -= use
            if not spare[0][1]:
                spare.pop(0)
        if sizes and group[0][0] == sizes[-1]:
            members[-1] += group
            counts[-1] += per - want
        else:
            members.append(group)
            sizes.append(group[0][0])
            counts.append(per - want)
    for shape, often in configurations(sizes, counts, capacity) if sizes else []:
        n = min([int(often + 1e-6), *(sum(c for _, c in members[i]) // k for i, k in enumerate(shape) if k)])
        if n <= 0:
            continue
        classes = [(bins.open(n), n, capacity)]
        for i, k in enumerate(shape):
            for _ in range(k):
                cut = []
                for base, m, room in classes:
                    while m:
                        length, left = members[i][0]
                        use = min(m, left)
                        bins.place(length, use, base, capacity - room)
                        cut.append((base, use, room - length))
                        members[i][0][1] -= use
                        if not members[i][0][1]:
                            members[i].pop(0)
                        base, m = base + use, m - use
                classes = cut
        for base, m, room in classes:
            bins.put(room, base, m)
    rest: dict[int, int] = defaultdict(int)
    for group in members:
        for n, c in group:
            rest[n] += c
    for n, c in histogram.items():
        if n <= large:
            rest[n] += c
    for n in sorted(rest, reverse=True):
        bins.best_fit(n, rest[n])
    return bins.runs, bins.next
