"""Linear suffix sorting by grouping, many texts at once.

Phase one sorts all suffixes into groups of equal Lyndon prefix. It visits the groups in descending order;
each suffix of a group points back to the nearest earlier suffix of a lower group (the previous smaller
one), and the suffixes pointed at are split off their group by the number of pointers they received. Phase
two walks the groups in ascending order and emits the order inside each by following the same pointers; no
suffix is renamed or sorted again.

Both phases advance all texts of the batch in step: step ``t`` handles the ``t``-th group (or rank) of every
text, so the work of numpy is per step and the cost per byte does not depend on how many texts there are.
"""

from __future__ import annotations

import numpy as np


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges ``start .. start + size - 1``, range after range."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def suffix_arrays(symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``symbols[offs[i]:offs[i+1]]``, as places in ``symbols``, text after text.

    The end of a text sorts below every symbol. Symbols are integers of any range.
    """
    lengths = np.diff(offs)
    texts = len(lengths)
    # Place 0 is a guard below everything; each text gets an end mark below its symbols.
    base = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(base[-1])
    owner = np.repeat(np.arange(texts), lengths + 1)
    s = np.full(n, -1, dtype=np.int32)
    body = np.ones(n, dtype=bool)
    body[0] = False
    body[base[1:] - 1] = False
    s[body] = np.asarray(symbols, dtype=np.int32) - (int(symbols.min()) if len(symbols) else 0)
    low = np.concatenate([[0], base[owner]]).astype(np.int32)

    member = np.concatenate([[0], 1 + np.lexsort((s[1:], owner))]).astype(np.int32)
    place = np.empty(n, dtype=np.int32)
    place[member] = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[2:] = (s[member[2:]] != s[member[1:-1]]) | (low[member[2:]] != low[member[1:-1]])
    first = np.flatnonzero(new)
    size = np.zeros(n, dtype=np.int32)
    size[first] = np.diff(np.append(first, n))
    head = np.zeros(n, dtype=np.int32)  # by last place of a group: its first
    head[first + size[first] - 1] = first
    key = np.empty(n, dtype=np.int32)
    key[member] = np.repeat(first, size[first])
    back = np.arange(-1, n - 1, dtype=np.int32)
    back[0] = 0
    split = np.zeros(n, dtype=bool)

    now, floor = head[base[1:] - 1].copy(), base[:-1]
    while len(now):
        at = member[_spread(now, size[now])]
        left = np.arange(len(at))
        while len(left):
            i = at[left]
            p = back[i]
            left = left[key[p] >= key[i]]
            i = at[left]
            back[i] = back[back[i]]
        p = back[at]
        hit, count = np.unique(p[p >= low[at]], return_counts=True)
        if len(hit):
            order = np.lexsort((count, key[hit]))
            hit, count = hit[order], count[order]
            old = key[hit]
            begins = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            m = np.diff(np.append(begins, len(hit)))
            groups = old[begins]
            tail = groups + size[groups] - m
            to = _spread(tail, m)
            split[hit] = True
            there = member[to]
            moved = there[~split[there]]
            holes = place[hit]
            holes = holes[holes < np.repeat(tail, m)]
            split[hit] = False
            member[holes], place[moved] = moved, holes
            member[to], place[hit] = hit, to
            part = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])))
            part_size = np.diff(np.append(part, len(hit)))
            size[groups] -= m
            rest = groups[size[groups] > 0]
            head[rest + size[rest] - 1] = rest
            starts = to[part]
            size[starts] = part_size
            head[starts + part_size - 1] = starts
            key[hit] = np.repeat(starts, part_size)
        more = now > floor
        now, floor = head[now[more] - 1], floor[more]

    out = np.full(n, -1, dtype=np.int32)
    filled = np.zeros(n, dtype=np.int32)
    placed = np.zeros(n, dtype=bool)
    placed[0] = True
    live = np.argsort(-lengths, kind="stable")
    longest = lengths[live]
    out[base[:-1]] = base[1:] - 1
    placed[base[1:] - 1] = True
    for step in range(int(longest[0]) + 1 if texts else 0):
        live = live[: np.searchsorted(-longest, -step, side="right")]
        longest = longest[: len(live)]
        j = out[base[live] + step] - 1
        j = j[j >= base[live]]
        while len(j):
            j = j[~placed[j]]
            k = key[j]
            out[k + filled[k]] = j
            filled[k] += 1
            placed[j] = True
            below = low[j]
            j = back[j]
            j = j[j >= below]
    ranks = np.ones(n, dtype=bool)
    ranks[0] = False
    ranks[base[:-1]] = False
    return out[ranks] - np.repeat(np.arange(texts), lengths) - 1
