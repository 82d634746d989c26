"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

The classic scheme, with each of its sequential scans turned into one array
operation per byte bucket and round: suffixes are classified from right to
left, leftmost-smaller (LMS) substrings are sorted by a first induction and
named, and the order of the LMS suffixes, found on the string of names,
induces all others in linear work. Names are few bytes apart but many in kind,
so the recursion on their string renames neighbouring pairs (1, 2, 4, ... names
at a time) instead of inducing over a bucket for every name.
"""

from __future__ import annotations

import numpy as np

from fieldlens.llm.textkit import Rolling


def classify(s: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes: smaller than the suffix one to the right. The end counts as smallest."""
    n = len(s)
    less = np.zeros(n, bool)
    less[:-1] = s[:-1] < s[1:]
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    at = np.where(differs, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(sa: np.ndarray, found: np.ndarray, codes: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Puts positions into their buckets in order, from the front (step 1) or the back (step -1)."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    counts = np.bincount(codes, minlength=256)
    nth = np.arange(len(codes)) - (np.cumsum(counts) - counts)[codes]
    sa[edge[codes] + step * nth] = found[order]
    edge += step * counts


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that the order of the seeds (LMS positions) induces."""
    n = len(s)
    counts = np.bincount(s, minlength=256)
    head = np.cumsum(counts) - counts
    tail = head + counts
    used = np.flatnonzero(counts)
    sa = np.full(n, -1, np.int32)
    by_code = np.bincount(s[seeds], minlength=256) if len(seeds) else np.zeros(256, np.int64)
    seed_of = seeds[np.argsort(s[seeds], kind="stable")]
    seed_at = np.concatenate(([0], np.cumsum(by_code)))

    front = head.copy()
    _deal(sa, np.array([n - 1]), s[n - 1 :], front, 1)  # the last suffix follows from the end itself
    for c in used:
        done = head[c]
        while True:
            block = sa[done : front[c]]
            if not len(block):
                break
            done = front[c]
            left = block[block > 0] - 1
            left = left[~smaller[left]]
            if len(left):
                _deal(sa, left, s[left], front, 1)
        block = seed_of[seed_at[c] : seed_at[c + 1]]
        if len(block):
            left = block[block > 0] - 1
            _deal(sa, left, s[left], front, 1)

    back = tail - 1
    for c in used[::-1]:
        done = tail[c] - 1
        while True:
            block = sa[back[c] + 1 : done + 1][::-1]
            if not len(block):
                break
            done = back[c]
            left = block[block > 0] - 1
            left = left[smaller[left]]
            if len(left):
                _deal(sa, left, s[left], back, -1)
        block = sa[head[c] : front[c]][::-1]
        left = block[block > 0] - 1
        left = left[smaller[left]]
        if len(left):
            _deal(sa, left, s[left], back, -1)
    return sa


def _order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by renaming pairs of ever longer stretches."""
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) > 0)))
        rank = np.empty(len(order), np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == len(order) - 1 or width >= len(order):
            return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string (uint8)."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = induce(s, smaller, lms)
    if len(lms) < 2:  # nothing to sort
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = sa[is_lms[sa]]
    nth = np.empty(n, np.int64)
    nth[lms] = np.arange(len(lms))
    end = np.minimum(np.concatenate((lms[1:] + 1, [n])), n)
    body = Rolling(s).of(lms, end)[nth[rough]]
    size = (end - lms)[nth[rough]]
    size[nth[rough] == len(lms) - 1] = -1  # the last one ends with the text and equals no other
    name = np.concatenate(([0], np.cumsum((body[1:] != body[:-1]) | (size[1:] != size[:-1]))))
    if name[-1] == len(lms) - 1:
        return induce(s, smaller, rough)  # the substrings alone decide the order
    names = np.empty(len(lms), np.int64)
    names[nth[rough]] = name
    return induce(s, smaller, lms[_order_names(names)])


def permuted_lcp(s: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each text position's suffix with its predecessor in the suffix array, in text order.

    Only irreducible values are compared, eight bytes a step and up to ``most``;
    the others are one less than their left neighbour's. ``fresh`` positions are
    compared in any case. Values are right up to ``most`` less the distance to
    the last compared position.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    direct = (here == 0) | (before <= 0)
    direct |= s[here - 1] != s[before - 1]
    direct[fresh] = True
    at = np.flatnonzero(direct & (before >= 0))
    wide = np.zeros(n + 8, np.uint64)
    for k in range(8):
        wide[: max(n - k, 0)] |= s[k:].astype(np.uint64) << np.uint64(8 * k)
    value = np.zeros(n, np.int64)
    a, b, who, length = at, before[at], at, 0
    while len(a) and length < most:
        x = wide[np.minimum(a + length, n)] ^ wide[np.minimum(b + length, n)]
        same = x == 0
        if not same.all():
            y = x[~same]
            value[who[~same]] = length + np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        a, b, who = a[same], b[same], who[same]
        length += 8
    value[who] = length
    value = np.minimum(value, n - np.maximum(here, before))
    last = np.maximum.accumulate(np.where(direct, here, 0))
    value = np.maximum(value[last] - (here - last), 0)
    value[before < 0] = 0
    return value
