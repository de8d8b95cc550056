"""Suffix-array deduplication: bytes covered by a string of 50 bytes that an earlier document has too.

Documents are dealt over blocks by a hash of the id.  Windows of 50 bytes are anchored (see ``anchors``), and
only pieces around anchors that occur in several documents go on.  A piece that an earlier document has byte by
byte is removed at once.  Where an anchor has different pieces, one copy of each goes to the shard of the
anchor, which holds every window with that anchor of the whole corpus; the shard's suffix array, made by
induced sorting, and its permuted common prefixes tell which windows are equal.  What is found returns to the
blocks as byte ranges.  A shard may hold many anchors and works through them in batches of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.anchors import WINDOW, anchors
from quillspan.llm.suffixes import common_prefixes, suffix_array
from quillspan.llm.tables import settle
from quillspan.llm.words import rows

LAST = 2**63 - 1
BATCH_BYTES, SEND_ENTRIES = 2_000_000, 500_000
SENT = "shard int, block int, a binary, b binary, c binary, d binary, e binary, f binary"
REPLY = "block int, a binary, b binary, c binary, d binary, doc_id long, digest binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(schema: str, out: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*out)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _by_shard(shards: int, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    shard = (grams >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order].astype(np.int64))) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _send_anchors(shards: int):
    """Anchors of every document, packed: a row for each shard, with hashes by block."""

    def flush(grams, blocks):
        grams, blocks = np.concatenate(grams), np.concatenate(blocks)
        out = []
        for shard, part in _by_shard(shards, grams):
            part = part[np.lexsort((grams[part], blocks[part]))]
            names, counts = np.unique(blocks[part], return_counts=True)
            out.append((shard, None, grams[part].tobytes(), names.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), None, None, None))
        return _table(SENT, out).to_batches()

    def run(batches):
        grams, blocks, n = [], [], 0
        for block, text in rows(batches, "block", "text"):
            found = np.unique(anchors(_raw(text))[0])
            grams.append(found)
            blocks.append(np.full(len(found), block, np.int32))
            n += len(found)
            if n > 4 * SEND_ENTRIES:
                yield from flush(grams, blocks)
                grams, blocks, n = [], [], 0
        if n:
            yield from flush(grams, blocks)

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Of one shard: the anchors that occur in several documents, for each block that has them."""
    parts = [(np.frombuffer(a, np.uint64), np.repeat(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32))) for a, b, c in rows([table], "a", "b", "c")]
    grams, blocks = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(grams, kind="stable")
    grams, blocks = grams[order], blocks[order]
    same = grams[1:] == grams[:-1]
    several = np.append(same, False) | np.append(False, same)
    grams, blocks = grams[several], blocks[several]
    order = np.argsort(blocks, kind="stable")
    grams, blocks = grams[order], blocks[order]
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    return _table(REPLY, [(int(b[0]), np.unique(g).tobytes(), None, None, None, None, None) for b, g in zip(np.split(blocks, cuts), np.split(grams, cuts)) if len(b)])


def _documents(docs: pa.Table, reply: pa.Table) -> list[tuple]:
    """``(key, doc_id, text, copy)`` of a block in an order that depends on the rows only; copy: an earlier document has the text."""
    copies = {(i, d) for i, d in rows([reply], "doc_id", "digest") if d is not None}
    found = []
    for doc_id, text in rows([docs], "doc_id", "text"):
        digest = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        found.append((LAST if doc_id is None else doc_id, digest, doc_id, text, (doc_id, digest) in copies))
    found.sort(key=lambda f: f[:2])
    return [(key, doc_id, text, copy) for key, _, doc_id, text, copy in found]


def _send_pieces(shards: int):
    """Pieces around recurring anchors, as hashes: to the shard of the anchor."""

    def run(docs: pa.Table, reply: pa.Table) -> pa.Table:
        hot = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(a, np.uint64) for (a,) in rows([reply], "a") if a is not None)]))
        if not len(hot) or not len(docs):
            return _table(SENT, [])
        block = docs.column("block")[0].as_py()
        found = []
        for at, (key, _, text, copy) in enumerate(_documents(docs, reply)):
            if not copy:
                grams, pieces, starts, counts = anchors(_raw(text))
                near = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                kept = np.flatnonzero(hot[near] == grams)
                found.append((grams[kept], pieces[kept], np.full(len(kept), key), np.full(len(kept), at, np.int32), starts[kept].astype(np.int32), counts[kept].astype(np.uint8)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.uint64)]
        return _table(SENT, [(shard, block, *(c[part].tobytes() for c in columns)) for shard, part in _by_shard(shards, columns[0])])

    return run


KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8)


def _unpacked(table: pa.Table, kinds) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [[np.frombuffer(v, k) for v, k in zip(values, kinds)] for values in rows([table], *"abcdef"[: len(kinds)])]
    blocks = np.repeat(np.array(table.column("block").to_pylist(), np.int32), [len(p[0]) for p in parts])
    return [np.concatenate(c) for c in zip(*parts)], blocks


def _replies(kind: int, blocks: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows for each block: byte ranges of documents (kind 0), or pieces whose bytes are wanted (1)."""
    order = np.argsort(blocks, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        if len(part):
            values = [c[part].tobytes() for c in columns]
            out.append((int(blocks[part[0]]), bytes([kind]), *values, *[None] * (3 - len(values)), None, None))
    return out


def _equal_pieces(table: pa.Table) -> pa.Table:
    """Of one shard: pieces that an earlier document has too; and, of an anchor's different pieces, those of the earliest document."""
    (grams, pieces, keys, docs, starts, counts), blocks = _unpacked(table, KINDS)
    order = np.lexsort((starts, docs, blocks, keys, pieces, grams))
    grams, pieces, keys, docs, starts, counts, blocks = (c[order] for c in (grams, pieces, keys, docs, starts, counts, blocks))
    new_gram = np.append(True, grams[1:] != grams[:-1])
    new = new_gram | np.append(True, pieces[1:] != pieces[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = keys > keys[first]
    ends = starts + counts.astype(np.int32) + WINDOW - 1
    out = _replies(0, blocks[later], [docs[later], starts[later], ends[later]])
    group = np.cumsum(new_gram) - 1
    varied = np.bincount(group, new)[group] > 1
    wanted = ~later & varied
    out += _replies(1, blocks[wanted], [docs[wanted], starts[wanted], ends[wanted]])
    return _table(REPLY, out)


def _send_bytes(shards: int):
    """The bytes of wanted pieces, to the shard of their anchor."""

    def run(docs: pa.Table, reply: pa.Table) -> pa.Table:
        wanted = [[np.frombuffer(v, np.int32) for v in values] for kind, *values in rows([reply], "a", "b", "c", "d") if kind == b"\x01"]
        if not wanted or not len(docs):
            return _table(SENT, [])
        block = docs.column("block")[0].as_py()
        at, starts, ends = (np.concatenate(c) for c in zip(*wanted))
        order = np.lexsort((starts, at))
        at, starts, ends = at[order], starts[order], ends[order]
        texts, out = _documents(docs, reply), []
        grams, keys, pieces = [], [], []
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            key, _, text, _ = texts[at[part[0]]]
            raw = _raw(text)
            own, _, first, _ = anchors(raw)
            grams.append(own[np.searchsorted(first, starts[part])])
            keys.append(np.full(len(part), key))
            pieces += [raw[s:e].tobytes() for s, e in zip(starts[part], ends[part])]
        grams, keys = np.concatenate(grams), np.concatenate(keys)
        for shard, part in _by_shard(shards, grams):
            held = b"".join(pieces[i] for i in part)
            out.append((shard, block, grams[part].tobytes(), keys[part].tobytes(), at[part].tobytes(), starts[part].tobytes(), (ends - starts)[part].astype(np.int32).tobytes(), held))
        return _table(SENT, out)

    return run


def earlier_windows(pieces: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(piece, offset)`` of every window that a piece with a smaller key has, too; by suffix array."""
    length = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    text = np.ones(int((length + 1).sum()) + 1, np.int16)  # 1 after every piece, 0 at the end
    text[-1] = 0
    owner = np.repeat(np.arange(len(pieces)), length)
    place = np.arange(int(length.sum())) + owner
    text[place] = np.concatenate(pieces).astype(np.int16) + 2
    usable = np.zeros(len(text), bool)
    usable[place[place + WINDOW <= (begin + length)[owner]]] = True
    array = suffix_array(text)
    shared = common_prefixes(text, array, WINDOW, usable)
    array = array[usable[array]]
    starts_run = shared[array] < WINDOW
    of = np.searchsorted(begin, array, "right") - 1
    run_first = np.flatnonzero(starts_run)
    least = np.minimum.reduceat(keys[of], run_first)[np.cumsum(starts_run) - 1]
    hit = keys[of] > least
    return of[hit], array[hit] - begin[of[hit]]


def _equal_windows(table: pa.Table) -> pa.Table:
    """Of one shard: byte ranges that consist of windows of earlier documents."""
    (grams, keys, docs, starts, sizes), blocks = _unpacked(table, (np.uint64, np.int64, np.int32, np.int32, np.int32))
    held = np.concatenate([np.frombuffer(f, np.uint8) for (f,) in rows([table], "f")])
    begin = np.cumsum(sizes.astype(np.int64)) - sizes
    order = np.argsort(grams, kind="stable")
    group_ends = np.append(np.flatnonzero(np.diff(grams[order])) + 1, len(order))
    out, first = [], 0
    total = np.cumsum(sizes[order].astype(np.int64))
    while first < len(order):
        # whole anchors, about BATCH_BYTES at a time
        enough = np.searchsorted(total[group_ends - 1], (total[first - 1] if first else 0) + BATCH_BYTES)
        last = int(group_ends[min(enough, len(group_ends) - 1)])
        part, first = order[first:last], last
        of, offset = earlier_windows([held[begin[i] : begin[i] + sizes[i]] for i in part], keys[part])
        sort = np.lexsort((offset, of))
        of, offset = of[sort], offset[sort]
        if len(of):
            cut = np.append(True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1))
            piece = part[of[cut]]
            stop = np.append(offset[:-1][cut[1:]], offset[-1])
            out += _replies(0, blocks[piece], [docs[piece], starts[piece] + offset[cut].astype(np.int32), starts[piece] + stop.astype(np.int32) + WINDOW])
    return _table(REPLY, out)


def _cut(docs: pa.Table, reply: pa.Table) -> pa.Table:
    """Documents without the ranges found for them."""
    found = [[np.frombuffer(v, np.int32) for v in values] for kind, *values in rows([reply], "a", "b", "c", "d") if kind == b"\x00"]
    at, starts, ends = (np.concatenate(c) for c in zip(*found)) if found else [np.empty(0, np.int32)] * 3
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(docs) + 1))
    out = []
    for i, (_, doc_id, text, copy) in enumerate(_documents(docs, reply)):
        raw = _raw(text)
        own = order[bounds[i] : bounds[i + 1]]
        depth = np.zeros(len(raw) + 1, np.int32)
        np.add.at(depth, starts[own], 1)
        np.add.at(depth, ends[own], -1)
        gone = np.cumsum(depth[:-1]) > 0
        if copy and len(raw) >= WINDOW:
            gone[:] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return _table(RESULT, out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes.  Every byte covered by a string of 50 bytes that also starts in a document with a
    smaller doc_id is removed; strings are judged on the input and never cross documents.  ``n_spans`` is the number
    of maximal removed runs; the hash is that of the bytes left.

    Null texts count as empty; texts of fewer than 50 bytes keep everything.  A null doc_id comes after all
    others, and rows with equal doc_ids remove nothing from each other.  Equal texts: all but those with the
    least doc_id go.  An empty table gives no rows; other columns are ignored.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    key = F.coalesce("doc_id", F.lit(LAST))
    light = docs.select("block", "doc_id", key.alias("key"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    least = light.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most")
    copies = light.join(least, "digest").filter("key > least").select("block", "doc_id", "digest").distinct()
    none = [F.lit(None).cast("binary").alias(c) for c in "abcd"]
    copies = settle(copies.select("block", *none, "doc_id", "digest"), "copies")

    sent = docs.select("block", "text").mapInArrow(_send_anchors(shards), SENT)
    hot = sent.groupBy("shard").applyInArrow(_recurring, REPLY)
    in_blocks = docs.groupBy("block")
    sent = in_blocks.cogroup(hot.unionByName(copies).groupBy("block")).applyInArrow(_send_pieces(shards), SENT)
    equal = settle(sent.groupBy("shard").applyInArrow(_equal_pieces, REPLY), "equal")
    sent = in_blocks.cogroup(equal.filter("a = X'01'").unionByName(copies).groupBy("block")).applyInArrow(_send_bytes(shards), SENT)
    windows = settle(sent.groupBy("shard").applyInArrow(_equal_windows, REPLY), "windows")
    every = equal.filter("a = X'00'").unionByName(windows).unionByName(copies)
    return in_blocks.cogroup(every.groupBy("block")).applyInArrow(_cut, RESULT)
