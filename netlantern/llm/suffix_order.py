"""Suffix arrays by linear grouping (Baier, "Linear-time Suffix Sorting", 2016).

Suffixes are grouped by their Lyndon prefixes: groups are taken from the greatest down, each member finds
its previous smaller suffix along the pointers of greater ones, and the suffixes pointed at move to a new
group above their old one, those with more pointers higher. Pointers of a group's rising members rise, so
members stay in text order without sorting. Then one pass in suffix order follows the same pointers and
gives each suffix the next place of its group; no string is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np

#: Members in text order; a group's only member may stand for itself.
Group = dict[int, None] | int | None


def suffix_array(text: bytes | list[int]) -> list[int]:
    """The starts of all suffixes in lexicographic order; a suffix comes before those it is a prefix of."""
    n = len(text)
    if not n:
        return []
    values = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else np.asarray(text)
    # The empty suffix is least; a group is known by the first place its members will have.
    order = np.argsort(values, kind="stable")
    _, first, sizes = np.unique(values[order], return_index=True, return_counts=True)
    label = np.empty(n + 1, np.int64)
    label[order] = np.repeat(first + 1, sizes)
    label[n] = 0
    label = label.tolist()
    groups: list[Group] = [None] * (n + 1)
    groups[0] = n
    for at, size in zip(first.tolist(), sizes.tolist()):
        groups[at + 1] = dict.fromkeys(order[at : at + size].tolist())
    smaller = _group(label, groups)
    return _places(label, groups, smaller)


def _group(label: list[int], groups: list[Group]) -> list[int]:
    """Refines the groups by Lyndon prefixes; the previous smaller suffix of each, or -1."""
    smaller = [-1] * len(label)
    for g in range(len(groups) - 1, -1, -1):
        members = groups[g]
        if members is None:
            continue
        if type(members) is int:
            j = members - 1
            while j >= 0 and label[j] >= g:
                j = smaller[j]
            smaller[members] = j
            old = groups[label[j]] if j >= 0 else None
            if type(old) is dict and len(old) > 1:
                del old[j]
                label[j] += len(old)
                groups[label[j]] = j
            continue
        # Rising members have rising pointers: equal ones follow one another.
        once: dict[int, list[int]] = {}
        often: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in members:
            j = i - 1
            while j >= 0 and label[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j == last:
                times += 1
                continue
            if times == 1 and last >= 0:
                once.setdefault(label[last], []).append(last)
            elif last >= 0:
                often.setdefault((times, label[last]), []).append(last)
            last, times = j, 1
        if times == 1 and last >= 0:
            once.setdefault(label[last], []).append(last)
        elif last >= 0:
            often.setdefault((times, label[last]), []).append(last)
        for times, at in sorted(often, reverse=True):
            _rise(label, groups, at, often[times, at])
        for at, some in once.items():
            _rise(label, groups, at, some)
    return smaller


def _rise(label: list[int], groups: list[Group], at: int, some: list[int]) -> None:
    """Moves some members of a group to a new one above what is left of it."""
    old = groups[at]
    if type(old) is int or len(some) == len(old):
        return
    for j in some:
        del old[j]
    new = at + len(old)
    groups[new] = dict.fromkeys(some) if len(some) > 1 else some[0]
    for j in some:
        label[j] = new


def _places(label: list[int], groups: list, smaller: list[int]) -> list[int]:
    """Each suffix's place, found from those already placed; without the empty suffix."""
    n = len(label) - 1
    order = [-1] * (n + 1)
    order[0] = n
    free = list(range(n + 1))  # the next place of each group
    placed = bytearray(n + 1)
    for k in range(n + 1):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = label[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order[1:]
