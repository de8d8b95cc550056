"""Suffix arrays by induced sorting, on numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; leftmost-smaller (LMS) substrings are
sorted by inducing from their first characters, named, and, where names repeat, sorted again as a string of
names (pairs of names get new names until all differ); one more induction gives the whole array.  Inducing goes
bucket by bucket, and inside a bucket in waves, each of which is one array operation.
"""

from __future__ import annotations

import numpy as np


def smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last one, the sentinel, is."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    inner = at < n - 1
    out[inner] = text[at[inner]] < text[at[inner] + 1]
    return out


def _split(text: np.ndarray, places: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append the places, in their order, to the buckets of their characters."""
    if len(places):
        char = text[places]
        order = np.argsort(char, kind="stable")
        places, char = places[order], char[order]
        cuts = np.flatnonzero(char[1:] != char[:-1]) + 1
        for first, part in zip([0, *cuts], np.split(places, cuts)):
            buckets[char[first]].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from the LMS suffixes in the given order."""
    chars = [int(c) for c in np.flatnonzero(np.bincount(text))]
    size = chars[-1] + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    front: list[list[np.ndarray]] = [[] for _ in range(size)]
    back: list[list[np.ndarray]] = [[] for _ in range(size)]
    _split(text, lms, seeds)

    def waves(start: list[np.ndarray], char: int, want_small: bool, buckets: list[list[np.ndarray]]) -> np.ndarray:
        wave, out = _joined(start), []
        while len(wave):
            out.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before] == want_small]
            here = text[before] == char
            _split(text, before[~here], buckets)
            wave = before[here]
        return _joined(out)

    larger: list[np.ndarray] = [np.empty(0, np.int32)] * size
    for c in chars:
        larger[c] = waves(front[c], c, False, front)
        seed = _joined(seeds[c])
        _split(text, seed[seed > 0] - 1, front)
    back[int(text[-1])].append(np.array([len(text) - 1], np.int32))
    parts = []
    for c in reversed(chars):
        parts.append(waves(back[c], c, True, back)[::-1])
        parts.append(larger[c])
        before = larger[c][::-1]
        before = before[before > 0] - 1
        _split(text, before[small[before]], back)
    return np.concatenate(parts[::-1])


def _names(text: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in the order given, equal ones alike."""
    end = np.empty(len(text), np.int32)
    end[lms] = np.append(lms[1:], len(text) - 1)
    a, b = ordered[:-1], ordered[1:]
    length = end[a] - a
    same = np.flatnonzero(length == end[b] - b)
    for step in range(int(length.max(initial=0)) + 1):
        open_ = length[same] >= step
        near = same[open_]
        near = near[text[a[near] + step] == text[b[near] + step]]
        same = np.concatenate([same[~open_], near])
        if not len(near):
            break
    fresh = np.ones(len(ordered), np.int64)
    fresh[same + 1] = 0
    return np.cumsum(fresh)


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    rank, step, n = names, 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        found, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        if len(found) == n or step >= n:
            return np.argsort(rank, kind="stable")
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order.  ``text``: small non-negative integers; the last, and only the last, is 0."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    small = smaller(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    array = induce(text, small, lms)
    ordered = array[is_lms[array]]
    names = _names(text, ordered, lms)
    if names[-1] == len(lms):
        return array if len(lms) == 1 else induce(text, small, ordered)
    by_place = np.empty(len(text), np.int64)
    by_place[ordered] = names
    return induce(text, small, lms[_sorted_names(by_place[lms])])


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int, usable: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place, the prefix it shares with the suffix before it in the array.

    Counted up to ``most``, and only between places that are both ``usable`` (0 elsewhere).
    """
    before = np.full(len(text), -1, np.int32)
    before[array[1:]] = array[:-1]
    out = np.zeros(len(text), np.int32)
    live = np.flatnonzero(usable & (before >= 0))
    live = live[usable[before[live]]]
    for step in range(most):
        live = live[text[live + step] == text[before[live] + step]]
        if not len(live):
            break
        out[live] = step + 1
    return out
