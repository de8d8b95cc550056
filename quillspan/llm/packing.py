"""Packing by power-of-two decomposition.

A document of L tokens is cut into whole windows and then one piece for every set bit of the rest, longest
first.  A piece is a sequence of its own; sequences of equal length form a bucket from which batches are
drawn, so no sequence crosses documents and, every length being a power of two, none needs padding.
The work is a map: no group, however large, is gathered anywhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import BATCH_CHARS, CACHE_CUTS, encoded, forget
from quillspan.llm.words import HASHES, rows

WINDOW, END_ID = 1024, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def piece_lengths(tokens: int, window: int = WINDOW) -> list[int]:
    """Whole windows, then the binary digits of the rest from high to low."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]


LEAN_CUTS, LEAN_CHARS = 100_000, 250_000


def _pieces(path: str, window: int, keep_ids: bool, cache_cuts: int, lean: bool = False):
    def run(batches):
        if not lean:
            yield from pieces(batches, cache_cuts, BATCH_CHARS)
            return
        HASHES.clear()  # of an earlier step in this worker
        try:
            yield from pieces(batches, min(cache_cuts, LEAN_CUTS), LEAN_CHARS)
        finally:
            forget(path, min(cache_cuts, LEAN_CUTS))

    def pieces(batches, most_cuts, batch_chars):
        for group in encoded(((t, i) for i, t in rows(batches, "doc_id", "text")), path, most_cuts, batch_chars):
            out: list[tuple] = []
            for (doc_id,), _, ids in group:
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), window):
                    part = ids[start : start + length]
                    out.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32) if keep_ids else None))
                    start += length
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = True, cache_cuts: int = CACHE_CUTS, lean: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor has.  A document's ids are
    those of its whole text and then id 0; every id lies in exactly one piece.  ``window`` is a power of two.
    ``sequence_id`` is unique (it numbers the rows of each partition); ``offset`` is always 0.  ``length`` is
    the bucket.  ``ids`` is null without ``keep_ids``.  ``cache_cuts`` bounds what a worker remembers; more of it
    saves encoding and changes no result.  ``lean`` encodes fewer texts at a time and keeps nothing between tasks, for
    workers that share their memory with other steps; it changes no result either.

    Null or empty texts: one piece of one id.  Null doc_ids and repeated rows are packed like any other row.
    Very long texts give as many windows as they need.  An empty table gives no rows; other columns are ignored.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(_pieces(tokenizer, window, keep_ids, cache_cuts, lean), SCHEMA)
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )
