"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

A suffix is of type S if it is smaller than the next one, else L.  The leftmost suffixes
of S runs (LMS) are sorted first: inducing puts their substrings in order, equal ones get
equal names, and where names repeat, the string of names is sorted in the same way (one
in which few names repeat, by ranks of growing runs).  From the sorted LMS suffixes, a
pass from the left induces the L suffixes and one from the right the S suffixes; each
moves every suffix once.  A pass takes as many suffixes at a time as it can before one of
them lands: each puts its left neighbour at the next slot of that one's bucket.

Texts end with 0, which is nowhere else.
"""

from __future__ import annotations

import numpy as np

_WIDTH = 1 << 17


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes.  The last one is S."""
    n = len(text)
    differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    at = np.repeat(differs, np.diff(differs, prepend=-1))  # the next place where a change follows
    s = np.ones(n, bool)
    s[: n - 1] = text[at[: n - 1]] < text[at[: n - 1] + 1]
    return s


def _places(buckets: np.ndarray) -> np.ndarray:
    """How many earlier entries are in the same bucket."""
    order = buckets.argsort(kind="stable")
    ordered = buckets[order]
    count = np.arange(len(order))
    first = np.zeros(len(order), np.int64)
    np.multiply(count[1:], ordered[1:] != ordered[:-1], out=first[1:])
    out = np.empty(len(order), np.int64)
    out[order] = count - np.maximum.accumulate(first)
    return out


def _pass(text: np.ndarray, moves: np.ndarray, sa: np.ndarray, slot: np.ndarray, sign: int) -> None:
    """One pass over sa (unfilled: -1), from the left (sign 1) or the right (-1).  An entry
    i whose left neighbour moves puts i - 1 at the next slot of its bucket."""
    n, at, width = len(sa), 0, 256
    view = sa if sign > 0 else sa[::-1]
    while at < n:
        width = min(width, n - at)
        left = view[at : at + width] - 1
        who = np.flatnonzero((left >= 0) & moves[left])
        done = width
        if len(who):
            left = left[who]
            bucket = text[left]
            target = slot[bucket] + sign * _places(bucket)
            lands = np.minimum.accumulate(target if sign > 0 else n - 1 - target) - at
            late = lands[:-1] < who[1:]  # what lands inside the block is read in the next one
            k = int(late.argmax()) if len(late) else 0
            if not (len(late) and late[k]):
                k = len(who) - 1
            if lands[k] < width:
                done = int(lands[k]) if k + 1 == len(who) or late[k] else width
            if k + 1 < len(who):
                left, bucket, target = left[: k + 1], bucket[: k + 1], target[: k + 1]
            sa[target] = left
            slot[bucket] = target + sign  # of equal buckets the last one counts
        at += done
        width = max(64, min(done + (done >> 1), _WIDTH))


def _by_pairs(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text whose entries nearly all differ, by ranks of runs of 1,
    2, 4 and more entries."""
    n, span = len(text), 1
    rank = np.append(text.astype(np.int64) + 1, 0)
    while True:
        key = rank[:n] * (n + 2)
        key[: n - span] += rank[span:n] if span < n else 0
        sa = key.argsort(kind="stable")
        ordered = key[sa]
        new = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        if new[-1] == n:
            return sa.astype(np.int32)
        rank[sa] = new
        span *= 2


def _induce(text: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All suffixes, induced from LMS suffixes (in the order in which they are given)."""
    sa = np.full(len(text), -1, np.int32)
    back = lms[::-1]
    sa[stops[text[back]] - 1 - _places(text[back])] = back
    _pass(text, ~s, sa, starts.copy(), 1)
    sa[1:][(sa[1:] >= 0) & s[sa[1:]]] = -1
    _pass(text, s, sa, stops - 1, -1)
    return sa


def _equal_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a : a + size] equals text[b : b + size], for each of many spans."""
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    same = text[np.repeat(a, size) + step] == text[np.repeat(b, size) + step]
    return np.logical_and.reduceat(same, first)


def suffix_array(text: np.ndarray, differing: int = 0) -> np.ndarray:
    """The order of all suffixes of text (unsigned integers; its last entry is 0 and no
    other is).  differing: how many different entries it has, if that is known."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    if differing * 4 >= n * 3:
        return _by_pairs(text)
    s = _types(text)
    sizes = np.bincount(text)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    rank = np.full(n, -1, np.int32)
    rank[lms] = np.arange(len(lms))
    sa = _induce(text, s, lms, starts, stops)
    ordered = sa[rank[sa] >= 0].astype(np.int64)  # LMS substrings in order
    size = np.diff(lms, append=n - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    size_a, size_b = size[rank[a]], size[rank[b]]
    new = np.ones(len(ordered), bool)
    alike = np.flatnonzero(size_a == size_b)
    if len(alike):
        new[1 + alike] = ~_equal_spans(text, a[alike], b[alike], size_a[alike])
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(lms):
        names = np.empty(len(lms), np.uint16 if name[-1] < 1 << 16 else np.uint32)
        names[rank[ordered]] = name
        ordered = lms[suffix_array(names, int(name[-1]) + 1)]
    return _induce(text, s, ordered, starts, stops)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in the text, how many entries its suffix has in common with the one
    before it in sa (the first suffix: 0).

    If the entries to the left of both are equal, the number is one less than that of the
    place to the left; only the other places are compared, four entries at a time."""
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (text[:-1] != text[np.maximum(before[1:], 1) - 1])
    fresh[1:] |= before[:-1] < 0
    wide = np.zeros(n + 4, np.uint64)
    wide[:n] = text
    four = wide[:n] | (wide[1 : n + 1] << np.uint64(16)) | (wide[2 : n + 2] << np.uint64(32)) | (wide[3 : n + 3] << np.uint64(48))
    common = np.zeros(n, np.int32)
    at = np.flatnonzero(fresh & (before >= 0))
    i, j, k = at, before[at].astype(np.int64), np.zeros(len(at), np.int32)
    while len(at):
        differs = four[i] ^ four[j]
        same = differs == 0
        low = differs[~same]
        low &= -low.view(np.int64).astype(np.int64).view(np.uint64)  # the lowest bit that differs
        common[at[~same]] = k[~same] + (np.bitwise_count(low - np.uint64(1)) // 16).astype(np.int32)
        at, i, j, k = at[same], i[same] + 4, j[same] + 4, k[same] + 4
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return common[last] - (place - last).astype(np.int32)


def repeats(text: np.ndarray, room: np.ndarray, width: int) -> np.ndarray:
    """The places where a string of width entries starts that also starts earlier in the
    text.  room is the number of entries from a place to the end of its segment; strings
    do not cross segments."""
    sa = suffix_array(text)
    deep = common_prefixes(text, sa)[sa] >= width
    deep &= room[sa] >= width
    deep[1:] &= room[sa[:-1]] >= width
    head = np.flatnonzero(~deep)
    sizes = np.diff(np.append(head, len(sa)))
    first = np.repeat(np.minimum.reduceat(sa, head), sizes)
    return np.sort(sa[(first != sa) & np.repeat(sizes > 1, sizes)])
