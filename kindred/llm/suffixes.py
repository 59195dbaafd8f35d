"""Suffix arrays by induced sorting, and permuted common prefixes, in steps over whole arrays.

A text is an array of bytes in which 0 ends each of its strings and occurs nowhere else.
"""

from __future__ import annotations

import numpy as np

from .text import spans_hashed


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is smaller than the next one, leftmost-smaller positions). Runs of equal bytes take the type after them."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1
    place = np.where(step != 0, np.arange(n), n - 1)
    after = np.minimum.accumulate(place[::-1])[::-1]
    smaller = step[after] > 0
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, left


def _induce(text: np.ndarray, smaller: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones.

    Byte by byte: what stands in a byte's bucket puts the suffixes one place to the left into theirs, those of larger
    type going up, those of smaller type then going down. Ends keep the order of the text. A bucket grows by itself only along a run of its byte.
    """
    counts = np.bincount(text, minlength=256)
    heads = np.cumsum(counts) - counts
    tails = np.cumsum(counts)
    order = np.full(len(text), -1, np.int64)
    byte = text[placed]
    by_byte = np.searchsorted(byte, np.arange(257))

    def put(found: np.ndarray, at: np.ndarray, down: bool) -> None:
        c = text[found]
        rank = np.argsort(c, kind="stable")
        c = c[rank]
        n = np.bincount(c, minlength=256)
        inside = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
        order[at[c] - 1 - inside if down else at[c] + inside] = found[rank]
        at += -n if down else n

    at = heads.copy()
    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < at[c]:
            batch = order[done : at[c]]
            done = at[c]
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            put(before, at, False)
        batch = placed[by_byte[c] : by_byte[c + 1]]
        before = batch[batch > 0] - 1
        put(before[~smaller[before]], at, False)
    larger_end = at.copy()
    at = tails.copy()
    for c in np.flatnonzero(counts)[:0:-1]:
        done = tails[c]
        while done > at[c]:
            batch = order[at[c] : done][::-1]
            done = at[c]
            before = batch[batch > 0] - 1
            put(before[smaller[before] & (text[before] != 0)], at, True)
        batch = order[heads[c] : larger_end[c]][::-1]
        before = batch[batch > 0] - 1
        put(before[smaller[before] & (text[before] != 0)], at, True)
    order[: tails[0]] = placed[: tails[0]]
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix ends with its string, and equal ones keep the order of the text.

    Leftmost-smaller substrings are put in order by induction and named; the names' own order follows by sorting ever
    longer runs of them until all differ, which ends at a string's end; then all suffixes are induced from them.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    smaller, left = _types(text)
    ends = np.flatnonzero(text == 0)
    smaller[ends] = True
    left = np.union1d(left, ends)
    body = left[text[left] != 0]
    if len(body):
        rough = _induce(text, smaller, np.concatenate([ends, body[np.argsort(text[body], kind="stable")]]))
        is_left = np.zeros(len(text), bool)
        is_left[body] = True
        ordered = rough[is_left[rough]]
        following = left[np.searchsorted(left, ordered) + 1]
        name_of = spans_hashed(text, ordered, following + 1)
        names = np.cumsum(np.append(0, name_of[1:] != name_of[:-1])) + len(ends)
        #: The reduced text, one name for each leftmost-smaller position; ends have names of their own, the smallest.
        reduced = np.zeros(len(left), np.int64)
        reduced[np.searchsorted(left, ordered)] = names
        reduced[np.searchsorted(left, ends)] = np.arange(len(ends))
        width = 1
        while True:
            ahead = np.zeros(len(reduced), np.int64)
            ahead[:-width] = reduced[width:] + 1
            ahead[reduced < len(ends)] = 0
            pair = reduced * (len(reduced) + 2) + ahead
            rank = np.argsort(pair, kind="stable")
            fresh = np.cumsum(np.append(0, np.diff(pair[rank]) != 0))
            same = fresh[-1] == len(reduced) - 1
            reduced[rank] = fresh
            if same or width >= len(reduced):
                break
            width *= 2
        placed = np.empty(len(left), np.int64)
        placed[reduced] = left
    else:
        placed = ends
    return _induce(text, smaller, placed)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, how many bytes its suffix has in common with the one before it in order, within their strings.

    Only where the bytes to the left differ is a prefix measured; at all other places it is one less than at the place
    to the left.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    inner = np.arange(1, n)
    fresh[1:] = (before[1:] < 1) | (before[1:] != before[:-1] + 1) | (text[inner - 1] != text[np.maximum(before[1:] - 1, 0)]) | (text[inner - 1] == 0)
    length = np.zeros(n, np.int64)
    left = np.flatnonzero(fresh & (before >= 0))
    k = 0
    while len(left):
        a, b = text[left + k], text[before[left] + k]
        left = left[(a == b) & (a != 0)]
        k += 1
        length[left] = k
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(length[start] - (np.arange(n) - start), 0)
