"""Suffix array by grouping: a linear-time construction without recursion or renaming.

Every suffix has a Lyndon prefix: the part before the next smaller suffix. Phase 1 groups the
suffixes by Lyndon prefix, in order of these. It starts from groups by first symbol and handles the
groups in descending order: every member learns its previous smaller suffix, and the suffixes so
pointed at, whose Lyndon prefixes grow by that of the handled group as many times as they are
pointed at, leave their group for a new one just above it, those with most pointers highest.
Phase 2 walks the suffix array upwards from the sentinel and, along the previous-smaller pointers,
puts each suffix at the lowest free place of its group; every group is sorted when it is reached.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The start of every suffix, in ascending order; a suffix precedes its own extensions."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(symbols, return_inverse=True)
    text = np.zeros(n + 1, np.int64)  # the sentinel, last, is the one symbol 0
    text[:n] = rank + 1
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(text[order], text)
    # place[i]: where i is in slots; head[i]: the first slot of i's group; size by first slot
    slots, head = order.tolist(), first.tolist()
    inverse = np.empty(n + 1, np.int64)
    inverse[order] = np.arange(n + 1)
    place = inverse.tolist()
    size = [0] * (n + 1)
    begins, counts = np.unique(first, return_counts=True)
    for b, c in zip(begins.tolist(), counts.tolist()):
        size[b] = c
    prev = [-1] * (n + 1)
    pending = -2
    waiting: list[int] = []
    top = n + 1  # the groups at and above this slot have been handled
    while top > 0:
        low = head[slots[top - 1]]
        if top - low == 1:
            # one member, which is the usual case
            s = slots[low]
            p = s - 1
            while p >= 0 and head[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                h = head[p]
                k = size[h]
                if k > 1:
                    k -= 1
                    last = h + k
                    a, q = place[p], slots[last]
                    slots[a], place[q] = q, a
                    slots[last], place[p] = p, last
                    size[h], size[last], head[p] = k, 1, last
            top = low
            continue
        members = slots[low:top]
        for s in members:
            prev[s] = pending
        for s in members:
            if prev[s] != pending:
                continue
            waiting.append(s)
            p = s - 1
            while waiting:
                while p >= 0 and head[p] >= low and prev[p] != pending:
                    p = prev[p]
                if p >= 0 and head[p] >= low:  # a member whose pointer comes first
                    waiting.append(p)
                    p -= 1
                else:
                    prev[waiting.pop()] = p
                    # the one that waited for it goes on from that pointer
        times: dict[int, int] = {}
        for s in members:
            p = prev[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_count: dict[int, list[int]] = {}
            for p, t in times.items():
                by_count.setdefault(t, []).append(p)
            for t in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
                leaving: dict[int, int] = {}
                for p in by_count[t]:
                    h = head[p]
                    k = leaving.get(h, 0) + 1
                    leaving[h] = k
                    last = h + size[h] - k
                    a, q = place[p], slots[last]
                    slots[a], place[q] = q, a
                    slots[last], place[p] = p, last
                for h, k in leaving.items():
                    rest = size[h] - k
                    if rest:
                        new = h + rest
                        size[h], size[new] = rest, k
                        for x in range(new, new + k):
                            head[slots[x]] = new
        top = low
    # phase 2
    out = [-1] * (n + 1)
    out[0] = n
    free = list(range(n + 1))  # the lowest free slot of the group that starts here
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0:
            h = head[j]
            at = free[h]
            if place[j] < 0:
                break
            out[at] = j
            free[h] = at + 1
            place[j] = -1
            j = prev[j]
    return np.array(out[1:], np.int64)


def shared(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For neighbours in a suffix array, whether they share their first ``least`` symbols."""
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(np.maximum(a, b) + least <= len(symbols))
    for k in range(least):
        if not len(live):
            break
        live = live[symbols[a[live] + k] == symbols[b[live] + k]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out
