"""Suffix order by linear grouping.

First all suffixes are put into groups by their Lyndon prefix, the longest Lyndon word a suffix begins with. Groups start
as first symbols and are taken from the highest to the lowest; each suffix of a group finds its previous smaller one, the
nearest before it in a lower group, and these are parted from their groups by how many suffixes of the group in hand
point at them. Then the order inside the groups follows: going up the suffixes, the one before each and those its
pointers lead to take the next place in their groups. Nothing is renamed and no smaller text is sorted.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` in their order. The last symbol must be smaller than all others."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    start, prev = grouped(symbols)
    slot = list(range(n))
    out = [0] * n
    placed = bytearray(n)
    out[0] = n - 1
    slot[0], placed[n - 1] = 1, 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[slot[g]] = s
            slot[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(out, np.int64)


def grouped(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix the place at which its final group begins, and the previous smaller suffix or -1."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(first, n))
    begin, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin[order] = np.repeat(first, sizes)
    held[first] = sizes
    place_of = np.zeros(n, np.int64)
    place_of[order] = np.arange(n)
    at, start, size, place = order.tolist(), begin.tolist(), held.tolist(), place_of.tolist()
    prev = [-1] * n

    end = n
    while end:
        s = at[end - 1]
        g = start[s]
        if end - g == 1:
            j = s - 1
            while j >= 0 and start[j] > g:
                j = prev[j]
            prev[s] = j
            if j >= 0:
                h = start[j]
                m = size[h]
                if m > 1:
                    last, p = h + m - 1, place[j]
                    other = at[last]
                    at[p], place[other] = other, p
                    at[last], place[j] = j, last
                    size[h], size[last], start[j] = m - 1, 1, last
        else:
            pointed: dict[int, int] = {}
            for i in sorted(at[g:end]):
                j = i - 1
                while j >= 0 and start[j] >= g:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            for times in sorted(set(pointed.values()), reverse=True):
                parts: dict[int, list[int]] = {}
                for j, count in pointed.items():
                    if count == times:
                        parts.setdefault(start[j], []).append(j)
                for h, moved in parts.items():
                    m = size[h]
                    new = h + m - len(moved)
                    if new == h:
                        continue
                    last = h + m
                    for j in moved:
                        last -= 1
                        p, other = place[j], at[last]
                        at[p], place[other] = other, p
                        at[last], place[j], start[j] = j, last, new
                    size[h], size[new] = new - h, len(moved)
        end = g
    return start, prev
