"""Suffix array of a list of integers by linear grouping of Lyndon prefixes."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix comes before those that it is a prefix of.

    Suffixes are grouped by their first symbol. Then groups are taken in descending order: each member points to the nearest
    earlier suffix of a lower group, and the suffixes pointed to leave their groups upwards, by how often they are pointed
    to, because that many copies of the taken group's prefix follow theirs. When all are taken, a group holds the suffixes with
    one longest Lyndon prefix, and the order inside the groups follows from one pass over the ranks, without renaming.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for at, s in enumerate(order):
        if text[s] != text[order[first]]:
            first = at
        place[s], group[s] = at, first
        size[first] += 1
    before, counts = [-1] * n, [0] * n
    end = n - 1
    while end >= 0:
        begin = group[order[end]]
        touched: list[int] = []
        for s in sorted(order[begin : end + 1]) if end > begin else (order[begin],):
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = before[p]
            before[s] = p
            if p >= 0:
                if not counts[p]:
                    touched.append(p)
                counts[p] += 1
        if len(touched) == 1:
            batches = {counts[touched[0]]: touched}
        else:
            batches = {}
            for p in touched:
                batches.setdefault(counts[p], []).append(p)
        for count in sorted(batches, reverse=True):
            fresh: dict[int, int] = {}
            for p in batches[count]:
                old = group[p]
                size[old] -= 1
                last = old + size[old]
                other, at = order[last], place[p]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
                fresh[old] = fresh.get(old, 0) + 1
            target = {old: old + size[old] for old in fresh}
            for p in batches[count]:
                group[p] = target[group[p]]
                counts[p] = 0
            for old, k in fresh.items():
                size[target[old]] = k
        end = begin - 1
    out, done, begin = [-1] * n, [False] * n, list(group)
    heads = list(range(n))

    def put(s: int) -> None:
        while s >= 0 and not done[s]:
            g = begin[s]
            out[heads[g]] = s
            heads[g] += 1
            done[s] = True
            s = before[s]

    put(n - 1)
    for at in range(n):
        put(out[at] - 1)
    return out
