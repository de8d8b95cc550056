"""Token counts of sections, from one encoding of the whole document.

The document is encoded once; the byte length of each token gives its span; spans and sections, both in
order, are joined as intervals by binary search.  A token that crosses boundaries is allocated by the rule:
``majority`` to the section with most of its bytes (the earliest of equals), ``start`` to the section with
its first byte, ``end`` to the section with its last byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import encoded, encoder
from quillspan.llm.words import rows

RULES = ("majority", "start", "end")
SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary.

    ``ends``: byte position after each token; ``starts``: first byte of each section, rising, from 0.
    """
    begins = np.append(0, ends)[:-1]
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = last > first
    chosen = last.copy() if rule == "end" else first.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            edges = np.concatenate([[begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]])
            chosen[t] = first[t] + int(np.argmax(np.diff(edges)))
    return chosen, crossing


def _starts(text: str, given: list[int] | None) -> list[int]:
    if given is None:
        at, out = -1, [0]
        while (at := text.find("\n", at + 1)) >= 0:
            out.append(at + 1)
        return out
    return sorted({0, *(min(max(s, 0), len(text)) for s in given if s is not None)})


def _bytes_at(text: str, starts: list[int]) -> np.ndarray:
    if text.isascii():
        return np.array(starts, np.int64)
    lead = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80
    return np.append(np.flatnonzero(lead), len(lead))[starts]


def _counts(path: str, rule: str, sections: bool):
    def run(batches):
        names = ("doc_id", "text", "starts") if sections else ("doc_id", "text")
        for group in encoded(((r[1], r[0], *r[2:]) for r in rows(batches, *names)), path):
            n_bytes = encoder(path).n_bytes
            out: list[list[np.ndarray | list]] = [[], [], [], [], [], []]
            for (doc_id, *given), text, ids in group:
                starts = _starts(text, given[0] if given else None)
                chosen, crossing = allocate(np.cumsum(n_bytes[ids]), _bytes_at(text, starts), rule)
                k = len(starts)
                parts = ([doc_id] * k, range(k), starts, [*starts[1:], len(text)], np.bincount(chosen, minlength=k), np.bincount(chosen[crossing], minlength=k))
                for column, part in zip(out, parts):
                    column.extend(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", starts: Column | None = None) -> DataFrame:
    """``doc_id, section, char_start, char_end, n_tokens, n_crossing`` for every section of every row.

    ``starts`` is an array of the character positions at which sections start; without it every line, with
    its line break, is a section.  A section from 0 is always added, repeated positions and nulls in the array
    count once or not at all, positions outside the text are moved to its ends.  The counts of a document's
    sections add up to the tokens of its whole text; ``n_crossing`` says how many of a section's tokens lie
    partly in another one.

    Null or empty texts, and texts of a single line: one section.  Null doc_ids and repeated rows are counted
    like any other row.  An empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if starts is not None:
        wanted.append(starts.cast("array<int>").alias("starts"))
    return docs.select(*wanted).mapInArrow(_counts(tokenizer, rule, starts is not None), SCHEMA)
