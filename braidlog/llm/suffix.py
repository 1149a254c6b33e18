"""Suffix array construction by linear grouping.

Phase 1 groups the suffixes by their Lyndon prefix. It starts from groups of equal first
symbols and takes the groups in descending order. When a group is taken, every member finds
the previous position whose group has not been taken (its previous smaller suffix so far);
that position's prefix grows by the member's, so it moves to a new group just above the
one it leaves, further up the more members it was found by. Phase 2 walks the order that
emerges: the suffix that follows a Lyndon prefix decides the rank within the group, so each
suffix that is emitted puts those whose prefixes end at it into their groups' next places.
Each suffix is taken once and moved once per find, so the time is linear; no names are
given to substrings and nothing recurses.
"""

from __future__ import annotations


def lyndon_groups(text: bytes) -> tuple[list[list[int]], list[int]]:
    """Groups of equal Lyndon prefix in ascending order, and the length of every prefix."""
    n = len(text)
    symbols = sorted(set(text))
    index = {c: g for g, c in enumerate(symbols)}
    group = [index[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    size = [len(m) for m in members]
    length = [1] * n
    open_at = list(range(-1, n))  # open_at[i + 1]: i itself while its group is open, then an earlier position
    done: list[list[int]] = []
    top = len(symbols) - 1
    while top >= 0:
        taken = [i for i in members[top] if group[i] == top]
        members[top] = taken
        for i in taken:
            open_at[i + 1] = i - 1
        if taken:
            done.append(taken)
            grown = length[taken[0]]
            found: dict[int, int] = {}
            for i in taken:
                j = i - 1
                while j != (up := open_at[j + 1]):
                    open_at[j + 1] = open_at[up + 1]
                    j = up
                open_at[i + 1] = j
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in found.items():
                moves.setdefault((group[j], times), []).append(j)
                length[j] += grown * times
            for g, times in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                moved = moves[g, times]
                if len(moved) == size[g]:
                    continue  # the whole rest of the group moves: it keeps its place
                size[g] -= len(moved)
                new = len(members)
                for j in moved:
                    group[j] = new
                members.append(moved)
                size.append(len(moved))
                higher = above[g]
                below.append(g)
                above.append(higher)
                above[g] = new
                if higher >= 0:
                    below[higher] = new
        top = below[top]
    done.reverse()
    return done, length


def suffix_array(text: bytes) -> list[int]:
    """Start positions of all suffixes of ``text`` in ascending order."""
    n = len(text)
    groups, length = lyndon_groups(text)
    place, start = [0] * n, 0
    ends_at: list[list[int]] = [[] for _ in range(n + 1)]
    free = [0] * len(groups)
    for g, members in enumerate(groups):
        free[g] = start
        start += len(members)
        for i in members:
            place[i] = g
    for i, size in enumerate(length):
        ends_at[i + size].append(i)
    out = [0] * n
    for rank in range(-1, n):
        for i in ends_at[out[rank] if rank >= 0 else n]:
            g = place[i]
            out[free[g]] = i
            free[g] += 1
    return out
