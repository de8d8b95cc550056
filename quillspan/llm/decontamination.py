"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of a bounded number of words; one block is sent to every task, and all
documents are compared with it where they lie, so no text is shuffled.  A first pass counts in how many
documents each n-gram of the items occurs; the rare ones of an item are its seeds.  A second pass finds the
seeds in each document and aligns the words around them with the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import ROWS, shingles, word_codes

GRAM, RARE_SHARE, BLOCK_WORDS = 3, 0.001, 2_000_000
MATCH, OTHER, GAP = 2, -1, -1
EDGES = b".,;:!?\"'()[]{}<>*_-|"
FOUND = "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a column without punctuation at their edges, and where those of each text begin; words of punctuation only are left out."""
    return word_codes(texts, EDGES)


class Block:
    """Test items with their n-grams: sorted hashes, and for each the items and places that have it."""

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        hashes, bounds = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.items = [(i, hashes[a:b]) for (i, _), a, b in zip(items, bounds[:-1], bounds[1:]) if a < b]
        grams = [shingles(w, size) for _, w in self.items]
        self.sizes = sorted({min(size, len(w)) for _, w in self.items})
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else owner
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner, self.place = flat[order], owner[order], place[order]
        self.known, self.marks = np.unique(self.gram), None

    def keep_rare(self, counts: np.ndarray, documents: int, share: float) -> None:
        """Seeds: n-grams in at most ``share`` of the documents, or not far above the item's usual n-gram.

        The second rule keeps the seeds of an item that has leaked into very many documents.
        """
        count = counts[np.searchsorted(self.known, self.gram)]
        sizes = np.bincount(self.owner, minlength=len(self.items))
        usual = count[np.lexsort((count, self.owner))][np.cumsum(sizes) - sizes + sizes // 2] if len(count) else count
        kept = count <= np.maximum(share * documents, 4 * usual[self.owner])
        self.gram, self.owner, self.place = self.gram[kept], self.owner[kept], self.place[kept]
        self.known, self.marks = np.unique(self.gram), None

    def _shift(self) -> np.uint64:
        return np.uint64(64 - min(24, max(8, int(16 * len(self.known)).bit_length())))

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of texts, places among their words, and the n-grams of the block that stand there, by their place in ``known``."""
        if self.marks is None:  # made by each worker; the leading bits of an n-gram keep most words out of the search
            self.marks = np.zeros(1 << (64 - int(self._shift())), bool)
            self.marks[self.known >> self._shift()] = True
        out = [(np.empty(0, np.int64),) * 3]
        for size in self.sizes if len(self.known) else ():
            if len(hashes) >= size:
                own = shingles(hashes, size)
                at = np.flatnonzero(self.marks[own >> self._shift()])
                near = np.minimum(np.searchsorted(self.known, own[at]), len(self.known) - 1)
                hit = self.known[near] == own[at]
                at, near = at[hit], near[hit]
                text = np.searchsorted(bounds, at, "right") - 1
                inside = at + size <= bounds[text + 1]
                out.append((text[inside], at[inside] - bounds[text[inside]], near[inside]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def seeds(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of text, item, place in the item, place in the text; one for each pair of equal n-grams, by text and item."""
        text, at, known = self.found(hashes, bounds)
        low, high = np.searchsorted(self.gram, self.known[known], "left"), np.searchsorted(self.gram, self.known[known], "right")
        n = high - low
        entry = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        out = np.stack([np.repeat(text, n), self.owner[entry], self.place[entry], np.repeat(at, n)], axis=1)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` with every row of ``windows``: score from 0 to 1, and the column where it ends."""
    steps = np.arange(windows.shape[1]) * -GAP
    above = np.zeros(windows.shape, np.int32)
    best, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for word in item:
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        here = np.maximum(np.maximum(diagonal + np.where(windows == word, MATCH, OTHER), above + GAP), 0)
        above = np.maximum.accumulate(here + steps, axis=1) - steps  # gaps along the row
        top = above.max(axis=1)
        better = top > best
        end[better] = above[better].argmax(axis=1)
        best = np.maximum(best, top)
    return best / (MATCH * len(item)), end


def _windows(length: int, seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches around seeds whose diagonals lie together: start of the diagonals, their end, number of seeds."""
    slack = max(8, length // 2)
    diagonals = np.sort(seeds[:, 3] - seeds[:, 2])
    groups, first = [], 0
    for i in range(1, len(diagonals) + 1):
        if i == len(diagonals) or diagonals[i] - diagonals[first] > slack:
            groups.append((int(diagonals[first]) - slack, int(diagonals[i - 1]) + length + slack, i - first))
            first = i
    return groups


def _count(block, size):
    def run(batches):
        b = block.value
        counts, documents = np.zeros(len(b.known), np.int64), 0
        for texts in (batch.column(0).slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            text, _, gram = b.found(*word_hashes(texts))
            pairs = np.unique(text * max(len(b.known), 1) + gram)
            counts += np.bincount(pairs % max(len(b.known), 1), minlength=len(b.known))
            documents += len(texts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], documents))], names=["gram", "n"])

    return run


def _search(block, threshold: float):
    def run(batches):
        b = block.value
        for batch in batches:
            waiting: dict[int, list[tuple]] = {}
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                doc_ids, texts = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text"))
                hashes, bounds = word_hashes(texts)
                seeds = b.seeds(hashes, bounds)
                new = np.flatnonzero((np.diff(seeds[:, :2], axis=0, prepend=-1) != 0).any(axis=1))
                for own in np.split(seeds, new[1:]) if len(seeds) else ():
                    text, item = int(own[0, 0]), int(own[0, 1])
                    begin, stop = bounds[text], bounds[text + 1]
                    for start, end, n in _windows(len(b.items[item][1]), own):
                        start = max(start, 0)
                        waiting.setdefault(item, []).append((doc_ids[text].as_py(), start, hashes[begin + start : min(begin + end, stop)].copy(), n))
            out: dict[tuple, tuple] = {}
            for item, found in waiting.items():
                item_id, query = b.items[item]
                found.sort(key=lambda f: len(f[2]))
                step = max(1, 2_000_000 // max(1, len(found[-1][2])))
                for at in range(0, len(found), step):
                    part = found[at : at + step]
                    windows = np.zeros((len(part), max(len(f[2]) for f in part)), np.uint64)
                    for k, f in enumerate(part):
                        windows[k, : len(f[2])] = f[2]
                    scores, ends = align(query, windows)
                    for k in np.flatnonzero(scores >= threshold):
                        doc_id, start, _, n = part[k]
                        last = start + int(ends[k])
                        new = (float(scores[k]), n, max(start, last + 1 - len(query)), last)
                        out[doc_id, item_id] = max(out.get((doc_id, item_id), new), new)
            if out:
                columns = [*zip(*out.keys()), *zip(*out.values())]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _blocks(items: DataFrame, most: int) -> list[list[tuple[int, str | None]]]:
    """The items in lists of at most about ``most`` words; one list at a time is on the driver."""
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = int(total // most) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in items.filter(part == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, size: int = GRAM, rare_share: float = RARE_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, score, n_seeds, first_word, last_word`` of documents that hold an item or an edited copy.

    ``docs(doc_id, text)``, ``items(item_id, text)``.  ``score`` is the best local alignment's score (2 for equal
    words, -1 for other words and for gaps) divided by that of the whole item; pairs of at least ``threshold`` are
    returned, one row each, with the number of seeds and about where in the document's words the copy stands.

    An item shorter than an n-gram is its own seed.  Items and documents without words match nothing.  Null ids
    are kept as null.  Repeated documents and items are paired each (rows with equal ids once a batch).  Empty
    tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    spark, out = docs.sparkSession, None
    for part in _blocks(items, block_words):
        block = Block(part, size)
        sent = spark.sparkContext.broadcast(block)
        counted = docs.select("text").mapInArrow(_count(sent, size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        n = {r["gram"]: r["n"] for r in counted}
        counts = np.array([n.get(i, 0) for i in range(len(block.known))], np.int64)
        block.keep_rare(counts, n.get(-1, 0), rare_share)
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(block), threshold), FOUND)
        out = found if out is None else out.unionByName(found)
    return out
