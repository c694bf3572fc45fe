"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai, in numpy."""

from __future__ import annotations

import numpy as np

#: Code that separates strings; it equals nothing, itself included.
BREAK = 0


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `codes` in the order of their first `depth` codes, ties by position.

    Ranks are refined by doubling: a round sorts suffixes that agree on their first h codes
    by the rank of the suffix h further on. As Larsson and Sadakane do, only suffixes that
    still share their rank with others take part; those alone are never touched again.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    # the first few codes at once; those past the end count as the least
    padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    bits = int(padded.max()).bit_length()
    h = max(1, min(8, 64 // bits, depth))
    wide = np.zeros(n, np.uint64)
    for k in range(h):
        wide = (wide << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(wide, kind="stable")
    wide = wide[order]
    new = np.ones(n, bool)  # whether a rank begins at each place of the order
    new[1:] = wide[1:] != wide[:-1]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a rank is the place of its first suffix
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    while h < depth:
        places = np.flatnonzero(~(new & np.append(new[1:], True)))  # of suffixes that aren't alone
        if not len(places):
            break
        suffixes, here = order[places], group[places]
        step = min(h, depth - h)
        there = rank[np.minimum(suffixes + step, n)]
        # one key for both ranks; a stable sort keeps the order of positions among equals
        again = np.argsort(here * (n + 1) + (there + 1), kind="stable")
        suffixes, there = suffixes[again], there[again]
        split = np.ones(len(places), bool)
        split[1:] = (here[1:] != here[:-1]) | (there[1:] != there[:-1])
        order[places] = suffixes
        new[places] |= split
        group[places] = places[split][np.cumsum(split) - 1]
        rank[suffixes] = group[places]
        h += step
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: length of the common prefix of suffixes order[i-1] and order[i]; lcp[0] = 0.

    Kasai's argument in text order: where position p-1 matches its predecessor's suffix y and
    the predecessor of p is y+1, the common prefix is one shorter than that of p-1. Such runs
    are followed at once; only the first position of each is compared code by code.
    """
    n = len(codes)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -2, np.int64)  # by position, the suffix sorted before
    before[order[1:]] = order[:-1]
    equal = (before >= 0) & (codes == codes[np.maximum(before, 0)]) & (codes != BREAK)
    follows = np.zeros(n, bool)
    follows[1:] = equal[:-1] & (before[1:] == before[:-1] + 1)
    heads = np.flatnonzero(~follows)
    x, y = heads, before[heads]
    length = np.zeros(len(heads), np.int64)
    go = np.flatnonzero(y >= 0)
    while len(go):
        i, j = x[go] + length[go], y[go] + length[go]
        inside = (i < n) & (j < n)
        go, i, j = go[inside], i[inside], j[inside]
        go = go[(codes[i] == codes[j]) & (codes[i] != BREAK)]
        length[go] += 1
    run = np.cumsum(~follows) - 1
    by_position = length[run] - (np.arange(n) - heads[run])
    lcp[:] = by_position[order]
    return lcp


def first_equal(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the places `starts` (sorted; `length` codes from each hold no BREAK) whether
    the same string of `length` codes begins at an earlier one of them."""
    order = suffix_array(codes, length)
    same = common_prefixes(codes, order) >= length
    wanted = np.zeros(len(codes), bool)
    wanted[starts] = True
    group = np.cumsum(~same)
    ours = wanted[order]
    group, place = group[ours], order[ours]  # ties of the order are by position: the first of a group is the earliest
    again = np.zeros(len(place), bool)
    again[1:] = group[1:] == group[:-1]
    out = np.zeros(len(codes), bool)
    out[place] = again
    return out[starts]
