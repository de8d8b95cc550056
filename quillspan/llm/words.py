"""Words of whole texts as 64-bit hashes, and other small helpers that run inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CACHE_WORDS, ROWS = 150_000, 500


def words(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, line or page breaks; A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """Word -> xxh3 hash.  Only a cache: it is emptied when full and never changes a result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


HASHES = WordHashes()


def free() -> None:
    """What a task no longer needs goes back to the system; a worker that waits for its next task holds little."""
    HASHES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none in other C libraries
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_WORD, _LOWER = np.ones(256, bool), np.arange(256, dtype=np.uint8)
_WORD[list(b" \t\n\r\x0b\x0c")] = False
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64


def whole_column(texts: pa.Array) -> pa.Array:
    """A copy that begins at 0, null being empty: some functions on strings take the wrong bytes of a slice."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def word_codes(texts: pa.Array, edges: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a column of texts, and where the words of each text begin, then their end.

    The words are those of ``words``, without bytes of ``edges`` at their ends, and left out when nothing else is in them; the
    hash is another one than that of ``HASHES``, made for all words at once, eight bytes at a time.
    """
    texts = whole_column(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    n = int(bounds[-1])
    padded = np.zeros(n + 8, np.uint8)
    if n:
        padded[:n] = _LOWER[np.frombuffer(data, np.uint8, n)]
    word = _WORD[padded[:n]]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins[inner], ends[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if edges and len(start):
        inner_byte = _WORD.copy()
        inner_byte[list(edges)] = False
        core = inner_byte[padded[:n]]
        upto, places = np.cumsum(core), np.flatnonzero(core)
        first, last = upto[start] - core[start], upto[end - 1]
        some = first < last
        start, end = places[first[some]], places[last[some] - 1] + 1
    size = end - start
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    codes = mix(size.astype(np.uint64))
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        live = live[size[live] > at]
        if len(live) == 0:
            break
        codes[live] = mix(codes[live] + (eights[start[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        codes[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]])
    return codes, np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence when it is shorter; empty for no words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = hashes[: n - size + 1].copy()
    for i in range(1, size):
        out = mix(out) + hashes[i : n - size + 1 + i]
    return mix(out)


def rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, some hundred at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.slice(at, ROWS).to_pylist() for c in columns))
