"""Suffix arrays by linear grouping, without recursive renaming.

Phase 1 keeps suffixes in ordered groups of equal known prefixes, at first their symbols, and
goes through the groups in descending order. The members of a finished group extend the
prefix of their previous smaller suffix, which moves to a new group right above its old one;
suffixes with more such members in a row move higher. In the end each group holds the
suffixes of one Lyndon prefix. Phase 2 goes through the suffixes in ascending order: when a
suffix is placed, the suffixes whose Lyndon prefix ends where it begins come next in their
groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted start positions of all suffixes of a sequence of non-negative integers."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)  # the last symbol is below all others
    text[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    kinds = int(text.max()) + 1
    group = text.tolist()
    members: list[set[int] | list[int]] = [[] for _ in range(kinds)]
    for i, g in enumerate(group):
        members[g].append(i)
    members = [set(m) for m in members]
    below = list(range(-1, kinds - 1))
    above = [*range(1, kinds), -1]
    ends = list(range(1, n + 1))
    # jump[i + 1] leads to the nearest position at or left of i whose group is still to come (0: none).
    jump = list(range(n + 1))

    current = kinds - 1
    while current >= 0:
        own = members[current]
        for i in own:
            jump[i + 1] = i
        count: dict[int, int] = {}
        for i in own:
            at = i
            while jump[at] != at:
                jump[at] = jump[jump[at]]
                at = jump[at]
            jump[i + 1] = at
            if at:
                parent = at - 1
                count[parent] = count.get(parent, 0) + 1
                if ends[i] > ends[parent]:
                    ends[parent] = ends[i]
        moves: dict[tuple[int, int], list[int]] = {}
        for parent, times in count.items():
            moves.setdefault((group[parent], -times), []).append(parent)
        for (old, times), moved in sorted(moves.items(), key=lambda m: m[0][1]) if len(moves) > 1 else moves.items():
            if len(moved) == len(members[old]):
                # All that is left of the old group moves: it keeps its place below those already moved.
                continue
            new = len(members)
            members[old].difference_update(moved)
            members.append(set(moved))
            for parent in moved:
                group[parent] = new
            # Larger counts came first, so each group lands right above the old one, below those.
            higher = above[old]
            below.append(old)
            above.append(higher)
            above[old] = new
            if higher >= 0:
                below[higher] = new
        current = below[current]

    bottom = group[n - 1]
    while below[bottom] >= 0:
        bottom = below[bottom]
    slot, free = 0, [0] * len(members)
    while bottom >= 0:
        free[bottom] = slot
        slot += len(members[bottom])
        bottom = above[bottom]
    by_end = np.argsort(np.array(ends), kind="stable").tolist()
    first = np.searchsorted(np.array(ends)[by_end], np.arange(n + 2)).tolist()
    out = [0] * n
    out[0] = n - 1
    for rank in range(n):
        k = out[rank]
        for i in by_end[first[k] : first[k + 1]]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
    return np.array(out[1:], np.int64)
