"""Suffix arrays of many short texts at once, by linear grouping.

A suffix's Lyndon prefix is its longest prefix that is smaller than all of
its own suffixes. Phase one sorts the suffixes into groups of equal Lyndon
prefixes: it starts with groups of equal first symbols and takes them in
descending order. Each member's previous-smaller pointer leads to the nearest
place to its left that is in a lower group; the Lyndon prefix of that place
grows by the group's, once for each member that points to it, so the places
pointed to leave their groups, the more often the higher. Phase two emits the
groups in ascending order: members of a group stand in the order of the
suffixes that follow their Lyndon prefixes, which are smaller and so have
their ranks already. Nothing is renamed and no smaller text is sorted.

The texts go through the phases in step: one group of each text at a time,
as array operations over all texts.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each count, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix arrays (as places in ``symbols``) of the texts between the
    offsets, one after the other. Symbols are 0 to 65535; a suffix that is a
    prefix of another one is smaller."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = text.astype(np.int64) << 16 | symbols.astype(np.int64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    count = np.zeros(n, np.int64)
    count[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, count[first])
    length = np.ones(n, np.int64)
    _group(order, rank, group, count, length, offsets, text)
    _emit(order, rank, group, count, length, offsets, text)
    return order


def _group(order, rank, group, count, length, offsets, text) -> None:
    """Phase one, in place."""
    n = len(order)
    full = np.flatnonzero(np.diff(offsets))
    low, high = offsets[full], offsets[full + 1]
    left = np.arange(-1, n - 1)  # previous-smaller pointers, as far as they are known
    left[low] = -1
    size_at_work, leaves = np.zeros(len(offsets), np.int64), np.zeros(n, bool)
    while len(high):
        start = group[order[high - 1]]
        many = high - start
        own = order[_spans(start, many)]
        more = start > low
        high, low = start[more], low[more]
        # pointers jump over everything that is not in a lower group
        todo, mine, to = own, group[own], left[own]
        while len(todo):
            on = np.flatnonzero((to >= 0) & (group[to] >= mine))
            todo, mine = todo[on], mine[on]
            to = left[to[on]]
            left[todo] = to
        place = np.sort(left[own])
        place = place[np.searchsorted(place, 0):]
        if not len(place):
            continue
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        times = np.diff(np.append(cut, len(place)))
        place = place[cut]
        heads = order[start]
        size_at_work[text[heads]] = length[heads]
        length[place] += times * size_at_work[text[place]]
        # the places leave the upper end of their groups, by times
        old = group[place]
        sort = np.argsort(old * (n + 1) + times, kind="stable")
        place, times, old = place[sort], times[sort], old[sort]
        change = old[1:] != old[:-1]
        new_old = np.flatnonzero(np.append(True, change))
        leaving = np.diff(np.append(new_old, len(old)))
        base = old[new_old]
        stay = count[base] - leaving
        slots = _spans(base + stay, leaving)
        there = order[slots]
        leaves[place] = True
        out = there[~leaves[there]]
        leaves[place] = False
        if len(out):
            was = rank[place]
            vacant = was[was < np.repeat(base + stay, leaving)]
            order[vacant] = out
            rank[out] = vacant
        order[slots] = place
        rank[place] = slots
        cut = np.flatnonzero(np.append(True, change | (times[1:] != times[:-1])))
        sizes = np.diff(np.append(cut, len(old)))
        count[base] = stay
        count[slots[cut]] = sizes
        group[place] = np.repeat(slots[cut], sizes)


def _emit(order, rank, group, count, length, offsets, text) -> None:
    """Phase two, in place: the order inside the groups of several members.

    Where a member is followed by another member of its group, the Lyndon
    prefix is repeated: fewer repeats come first, as what ends them is
    smaller, then the rank of what ends them decides.
    """
    start = np.flatnonzero(count > 1)
    if not len(start):
        return
    owner = text[order[start]]
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    turn = np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(owner))))
    by_turn = np.argsort(turn, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(turn[by_turn]) != 0)), len(turn))
    after = np.arange(len(order)) + length
    ends = after >= offsets[1:][text]
    after[ends] = len(order)
    kin = np.append(group, -1)
    rank_of = np.append(rank, -1)
    repeats, last = np.ones(len(order) + 1, np.int64), np.append(after, len(order))
    while True:  # doubling: skip the members of the same group that follow
        on = np.flatnonzero(kin[last[:-1]] == group)
        if not len(on):
            break
        jump = last[on]
        repeats[on] += repeats[jump]
        last[on] = last[jump]
    wide = len(order) + 2
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = start[by_turn[a:b]]
        many = count[own]
        slots = _spans(own, many)
        members = order[slots]
        follow = rank_of[last[members]] + 1
        # one key: text order of the slots, repeats, what follows
        sort = np.lexsort((repeats[members] * wide + follow, np.repeat(own, many)))
        members = members[sort]
        order[slots] = members
        rank_of[members] = slots


def equal_windows(symbols: np.ndarray, suffixes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix but the first of the list starts with the same
    ``width`` symbols as the one before it (of the same text)."""
    same = owner[1:] == owner[:-1]
    a, b = suffixes[:-1], suffixes[1:]
    for probe in (0, width - 1, width // 2):
        at = np.flatnonzero(same)
        same[at] = symbols[a[at] + probe] == symbols[b[at] + probe]
    at = np.flatnonzero(same)
    view = np.lib.stride_tricks.sliding_window_view(symbols, width)
    for k in range(0, len(at), 20_000):
        part = at[k:k + 20_000]
        same[part] = (view[a[part]] == view[b[part]]).all(axis=1)
    return same
