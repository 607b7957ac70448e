"""Suffix arrays of many short strings at once, by linear grouping.

Suffixes with the same Lyndon prefix form a group.  Groups are made in descending order:
each suffix of the highest open group points to the nearest earlier suffix of a lower group,
and suffixes that are pointed to rise to the top of theirs, the higher the more pointers
they get.  Then every group's order is emitted in ascending order along these pointers.  No
suffix is ever renamed.  Both passes take one step of all strings at a time in numpy.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of start[k] .. start[k] + length[k] - 1, and the k of each."""
    owner = np.repeat(np.arange(len(start)), length)
    first = np.cumsum(length) - length
    return np.arange(len(owner)) - first[owner] + start[owner], owner


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix array of each string, one behind the other, as places in ``symbols``.

    String k takes the places from begin[k] up to the next one's begin.  Each must end with
    a symbol that is smaller than all of its others.
    """
    n = len(symbols)
    end = np.append(begin[1:], n)
    string = np.repeat(np.arange(len(begin)), end - begin)
    low = begin[string]
    # one group for each first symbol; a group is named by its first slot
    slots = np.lexsort((symbols, string)).astype(np.int64)
    slot_of = np.empty(n, np.int64)
    slot_of[slots] = np.arange(n)
    ordered, owner = symbols[slots], string[slots]
    cut = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])])
    heads = np.flatnonzero(cut)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    head_at = np.full(n, -1, np.int64)  # by last slot of a group
    head_at[heads + size[heads] - 1] = heads
    group = np.empty(n, np.int64)
    group[slots] = np.repeat(heads, size[heads])
    before = np.arange(n, dtype=np.int64) - 1
    touched_now = np.zeros(n, bool)

    top = end.copy()
    live = np.arange(len(begin))
    while live.size:
        head = head_at[top[live] - 1]
        at, k = _spans(head, size[head])
        member, least, floor = slots[at], head[k], begin[live][k]
        top[live] = head
        # nearest earlier suffix of a lower group, by following pointers
        pending = np.arange(len(member))
        while pending.size:
            c = before[member[pending]]
            wrong = (c >= floor[pending]) & (group[np.maximum(c, 0)] >= least[pending])
            pending = pending[wrong]
            before[member[pending]] = before[c[wrong]]
        target = before[member]
        target = target[target >= floor]
        if target.size:
            target, count = np.unique(target, return_counts=True)
            order = np.lexsort((count, group[target]))
            target, count = target[order], count[order]
            g = group[target]
            new_group = np.concatenate([[True], g[1:] != g[:-1]])
            first = np.flatnonzero(new_group)
            many = np.diff(np.append(first, len(g)))
            lead = g[first]  # groups that lose suffixes to new ones at their end
            base = lead + size[lead] - many
            slot = np.repeat(base - first, many) + np.arange(len(g))
            # what holds the slots moves to the places that become free
            touched_now[target] = True
            held = slots[slot]
            out = held[~touched_now[held]]
            free = slot_of[target][slot_of[target] < np.repeat(base, many)]
            slots[free], slot_of[out] = out, free
            touched_now[target] = False
            slots[slot], slot_of[target] = target, slot
            runs = np.flatnonzero(new_group | np.concatenate([[True], count[1:] != count[:-1]]))
            lengths = np.diff(np.append(runs, len(g)))
            rest = size[lead] - many
            size[lead] = rest
            head_at[(lead + rest - 1)[rest > 0]] = lead[rest > 0]
            heads = slot[runs]
            size[heads] = lengths
            head_at[heads + lengths - 1] = heads
            group[target] = np.repeat(heads, lengths)
        live = live[top[live] > begin[live]]

    # emit: the smallest suffix is the last symbol; each suffix reached places those whose
    # next smaller one it is, from its left neighbour on along the pointers
    out = np.empty(n, np.int64)
    placed = np.zeros(n, bool)
    filled = np.zeros(n, np.int64)
    out[begin], placed[end - 1] = end - 1, True
    filled[group[end - 1]] = 1
    lengths = end - begin
    by_length = np.argsort(-lengths, kind="stable")
    falling = -lengths[by_length]
    for step in range(int(lengths.max(initial=0))):
        live = by_length[: np.searchsorted(falling, -step, side="left")]
        at = out[begin[live] + step] - 1
        floor = begin[live]
        while True:
            go = at >= floor
            at, floor = at[go], floor[go]
            go = ~placed[at]
            at, floor = at[go], floor[go]
            if not at.size:
                break
            g = group[at]
            out[g + filled[g]] = at
            filled[g] += 1
            placed[at] = True
            at = before[at]
    return out
