"""Minimiser anchors of byte strings: a link between equal windows wherever they stand.

A window of ``WINDOW`` bytes is anchored at the ``GRAM`` bytes in it with the least hash, the first of equal
ones.  That depends on the window's bytes only, so equal windows have equal anchors.  Neighbouring windows
mostly share an anchor: one anchor stands for a run of windows, its piece.
"""

from __future__ import annotations

import numpy as np

from quillspan.llm.words import mix

WINDOW, GRAM, BITS = 50, 20, 18
SPAN = WINDOW - GRAM + 1
PART = (1 << BITS) - WINDOW  # window starts that are looked at together
_BASE = 0x5851F42D4C957F2D
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << BITS), _powers(pow(_BASE, -1, 2**64), 1 << BITS)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows; ``raw`` has at most 2**BITS - 1 bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _UP[: len(raw)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray | int, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _DOWN[start])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every piece: hash of its anchor, hash of its bytes, first window start, number of windows."""
    found = []
    for at in range(0, max(len(raw) - WINDOW + 1, 0), PART):
        part = raw[at : at + PART + WINDOW - 1]
        n = len(part)
        sums = prefix_sums(part)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1])
        low = np.uint64((1 << BITS) - 1)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // SPAN) * SPAN, 2**64 - 1, np.uint64)
        padded[: len(keyed)] = keyed
        table = padded.reshape(-1, SPAN)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - WINDOW + 1
        least = np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        counts = np.diff(starts, append=windows)
        where = (least[starts] & low).astype(np.int64)
        found.append((grams[where], stretch_hashes(sums, starts, starts + counts + WINDOW - 1), starts + at, counts))
    if not found:
        none = np.empty(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))
