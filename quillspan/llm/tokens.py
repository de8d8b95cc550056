"""Token ids of whole texts by a byte-level tokenizer file.

In a byte-level BPE no token crosses a single space between two characters that aren't white space: the
space starts the next word.  So a text is cut there, every distinct cut is encoded once by the tokenizer,
and the text's ids are the ids of its cuts in order: the same ids as encoding the whole text at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CUTS, BATCH_CHARS, JOINED = 300_000, 1_000_000, 400
_CUT = re.compile(r"(?<=\S) (?=\S)")


#: White space in a text of which single blanks between words aren't the only cuts: as Python sees it, so that both agree.
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\pZ]"
_AWKWARD = rf"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|[\t\x0b-\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"


def _single_breaks(text: str) -> bool:
    """Only blanks and line breaks as white space, none beside another and none at an end."""
    found = text.split()
    breaks = text.count(" ") + text.count("\n")
    return len(found) - 1 == breaks and sum(map(len, found)) == len(text) - breaks


def cuts(text: str) -> list[str]:
    """The text in pieces that the tokenizer never joins; their concatenation is the text."""
    parts = text.split(" ") if _single_breaks(text) else _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


class Cuts(dict):
    """Cut -> number, in order of first sight; ``fresh`` lists those without ids yet."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, cut: str) -> int:
        number = self[cut] = len(self)
        self.fresh.append(cut)
        return number


class Encoder:
    def __init__(self, path: str, cache_cuts: int = CACHE_CUTS):
        self.cache_cuts = cache_cuts
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: bytes of each token: a byte-level vocabulary writes every byte as one character
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.at = Cuts()
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.cache_cuts or len(self.flat) > 10 * self.cache_cuts:
            self._clear()
        pieces = [cuts(t) for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        index = np.fromiter(map(self.at.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        self._learn()
        bounds = np.concatenate([[0], np.cumsum(self.length[index])])[np.cumsum(counts)]
        return np.split(self._flat(index), bounds[:-1])

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The same for a column of texts, null being empty; equal cuts of a column are looked up once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        awkward = pc.match_substring_regex(texts, rf"(?s){_AWKWARD}").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        out: list = [None] * len(texts)
        for place, ids in zip(np.flatnonzero(awkward), self.encode(texts.filter(pa.array(awkward)).to_pylist()) if awkward.any() else []):
            out[place] = ids
        plain = np.flatnonzero(~awkward)
        if len(plain) == 0:
            return out
        if len(self.at) > self.cache_cuts or len(self.flat) > 10 * self.cache_cuts:
            self._clear()
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offsets = parts.offsets.to_numpy()
        flat = parts.values
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        index = np.empty(len(flat), np.int64)
        index[first] = [self.at[p] for p in flat.filter(pa.array(first)).to_pylist()]
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        numbers = np.array([self.at[" " + p] for p in rest.dictionary.to_pylist()], np.int64)
        index[~first] = numbers[rest.indices.to_numpy()]
        self._learn()
        bounds = np.concatenate([[0], np.cumsum(self.length[index])])[offsets[1:]]
        for place, ids in zip(plain, np.split(self._flat(index), bounds[:-1])):
            out[place] = ids
        return out

    def _learn(self) -> None:
        """Ids of the fresh cuts.  A letter and then one full stop or comma at the end never share a token."""
        fresh, first = self.at.fresh, len(self.start)
        tails = [p for p in fresh if p[-1] in ",." and p[-2:-1].isalpha()]
        parts = np.array([(self.at[p[:-1]], self.at[p[-1]]) for p in tails], np.int64).reshape(-1, 2)
        self.start, self.length = np.append(self.start, np.zeros(len(fresh), np.int64)), np.append(self.length, np.zeros(len(fresh), np.int64))
        composed = np.fromiter(map(self.at.__getitem__, tails), np.int64, len(tails))
        simple = np.setdiff1d(np.arange(first, len(self.start)), composed, assume_unique=True)
        self._add(simple, *self._encode([fresh[i - first] for i in simple]))
        self._add(composed, self._flat(parts.ravel()), self.length[parts].sum(axis=1))
        self.at.fresh = []

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many cuts in a row at a time, as each but a text's first starts with its space."""
        alone = [p[0] != " " or p[1:2].isspace() or p[-1].isspace() for p in new]
        joined, row = [], []
        for cut, own in zip(new, alone):
            if own or len(row) == JOINED:
                joined += ["".join(row)]
                row = []
            row.append(cut)
            if own:
                joined += ["".join(row)]
                row = []
        found = [e.ids for e in self.tokenizer.encode_batch([*joined, "".join(row)], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        size = np.fromiter((len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in new), np.int64, len(new))
        ends = np.searchsorted(np.cumsum(self.n_bytes[flat]), np.cumsum(size)) + 1
        return flat, np.diff(ends, prepend=0)

    def _add(self, numbers: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        self.start[numbers] = len(self.flat) + np.cumsum(length) - length
        self.length[numbers] = length
        self.flat = np.concatenate([self.flat, flat])

    def _flat(self, index: np.ndarray) -> np.ndarray:
        """The ids of the cuts with these numbers, one after another."""
        length = self.length[index]
        before = np.cumsum(length) - length
        return self.flat[np.arange(int(length.sum())) + np.repeat(self.start[index] - before, length)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_cuts: int = CACHE_CUTS) -> Encoder:
    """One for each worker process and file.  ``cache_cuts``: distinct cuts that it remembers, some 200 bytes each."""
    if (path, cache_cuts) not in _ENCODERS:
        _ENCODERS[path, cache_cuts] = Encoder(path, cache_cuts)
    return _ENCODERS[path, cache_cuts]


def forget(path: str, cache_cuts: int) -> None:
    """What the worker holds of an encoder goes."""
    _ENCODERS.pop((path, cache_cuts), None)
    pa.default_memory_pool().release_unused()


def encoded(keyed: Iterator[tuple], path: str, cache_cuts: int = CACHE_CUTS, batch_chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of ``(row, text, ids)`` for ``(text, *row)``, a bounded number of characters at a time; null is empty."""
    pending: list[tuple] = []
    chars = 0

    def done():
        texts = [t for t, _ in pending]
        return [(row, text, ids) for (text, row), ids in zip(pending, encoder(path, cache_cuts).encode(texts))]

    for text, *row in keyed:
        pending.append((text or "", row))
        chars += len(text or "")
        if chars >= batch_chars or len(pending) >= 5000:
            yield done()
            pending, chars = [], 0
    if pending:
        yield done()


COLUMN_BYTES = 16 << 20


def encoded_columns(batches: Iterator[pa.RecordBatch], path: str, cache_cuts: int = CACHE_CUTS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """``(doc_ids, ids)`` of the rows of batches with ``doc_id, text``, some megabytes of text at a time."""
    own = encoder(path, cache_cuts)
    for batch in batches:
        doc_ids, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + COLUMN_BYTES, "right")))
            yield doc_ids.slice(at, to - at).to_pylist(), own.encode_column(texts.slice(at, to - at))
            at = to
