"""Token ids of documents in binary files: blocks in patched frame of reference.

Ids lie in ascending order of doc_id, each document's own and then an end id.  A block holds ``BLOCK`` ids: its least
id, then the differences to it in a width that the ``PERCENT`` per cent smallest of them need.  Of a larger difference
the low bits are packed with the rest, its place and its high bits go to the block's list of exceptions.

    block    width 1 byte, exceptions 1 byte, least id 4 bytes, packed low bits (16 * width bytes),
             places of the exceptions 1 byte each, their high bits 4 bytes each
    segment  whole documents of at least ``SEGMENT`` ids together (the last has fewer), cut into blocks; the last
             block is filled up with its last id

A segment is one row of a Parquet table: ``part`` and ``first`` (ids before it in its part: the order), ``n_ids``,
``doc_ids``, ``starts`` (each document's first id in the segment), ``block_starts`` (byte of each block in ``blocks``)
and ``blocks``.  So the index is read
without the ids, and one document's ids need only the blocks it touches.  All numbers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.tables import small_batches
from quillspan.llm.tokens import CACHE_CUTS, encoded_columns
from quillspan.session import shared_folder

BLOCK, PERCENT, SEGMENT, END_ID = 128, 90, 1 << 18, 2
HEAD = 6
SCHEMA = "part int, first long, n_ids long, doc_ids array<long>, starts array<long>, block_starts array<int>, blocks binary"
ROW_GROUP = 8 << 20


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number below 2**32 needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers below ``2**width`` as rows of bytes; eight numbers take ``width`` bytes."""
    eights = low.reshape(-1, 8).astype(np.uint64)
    out = np.zeros((len(eights), width), np.uint8)
    for i in range(8):
        first, shift = divmod(i * width, 8)
        moved = eights[:, i] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.reshape(len(low), -1)


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    groups = packed.reshape(-1, width)
    out = np.empty((len(groups), 8), np.uint64)
    for i in range(8):
        first, shift = divmod(i * width, 8)
        value = np.zeros(len(groups), np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, i] = (value >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(len(packed), BLOCK)


def pack_ids(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``(blocks, block starts)`` of ids below 2**32; no ids, no blocks."""
    n = len(ids)
    if n == 0:
        return b"", np.empty(0, np.int32)
    values = np.concatenate([ids, np.repeat(ids[-1:], -n % BLOCK)]).astype(np.uint32).reshape(-1, BLOCK)
    least = values.min(axis=1)
    values = values - least[:, None]
    place = -(-BLOCK * PERCENT // 100) - 1
    width = _widths(np.partition(values, place, axis=1)[:, place])
    odd = (values.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    n_odd = odd.sum(axis=1)
    size = HEAD + BLOCK // 8 * width + 5 * n_odd
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[starts], out[starts + 1] = width, n_odd
    out[starts[:, None] + np.arange(2, HEAD)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        low = values[own] & np.uint32((1 << int(w)) - 1)
        out[(starts[own] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)] = _packed(low, int(w))
    block, at = np.nonzero(odd)
    after = starts[block] + HEAD + BLOCK // 8 * width[block]
    order = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    out[after + order] = at
    high = (values[block, at].astype(np.uint64) >> width[block].astype(np.uint64)).astype("<u4")
    out[(after + n_odd[block] + 4 * order)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.int32)


def unpack_blocks(blocks: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these bytes, one block after another."""
    data, starts = np.frombuffer(blocks, np.uint8), np.asarray(starts, np.int64)
    if len(starts) == 0:
        return np.empty(0, np.uint32)
    width, n_odd = data[starts].astype(np.int64), data[starts + 1].astype(np.int64)
    least = data[starts[:, None] + np.arange(2, HEAD)].copy().view("<u4").ravel()
    out = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        out[own] = _unpacked(data[(starts[own] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)], int(w))
    block = np.repeat(np.arange(len(starts)), n_odd)
    order = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    after = starts[block] + HEAD + BLOCK // 8 * width[block]
    high = data[(after + n_odd[block] + 4 * order)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    out[block, data[after + order]] |= high.astype(np.uint64) << width[block].astype(np.uint64)
    return (out + least[:, None]).astype(np.uint32).ravel()


def _segments(path: str, end_id: int, cache_cuts: int):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list = []
        size = 0

        def segment() -> pa.RecordBatch:
            length = np.array([len(h) for h in held], np.int64)
            blocks, starts = pack_ids(np.concatenate(held))
            row = [[part], [first], [size], [doc_ids], [np.cumsum(length) - length], [starts], [blocks]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for group, encoded in encoded_columns(batches, path, cache_cuts):
            for doc_id, ids in zip(group, encoded):
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(held[-1])
                if size >= SEGMENT:
                    yield segment()
                    first += size
                    doc_ids, held, size = [], [], 0
        if held:
            yield segment()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, cache_cuts: int = CACHE_CUTS) -> str:
    """Encode ``doc_id, text`` and write the files; returns their folder, a new one below the shared folder if none is given.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor has.  Rows without an id come first;
    rows of one id follow in the order of the input.  Null and empty texts are the end id alone.  A document lies in one
    segment, however long it is.  An empty table writes files without rows; other columns are ignored.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/llm/token-files-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    ordered = docs.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")
    segments = ordered.mapInArrow(_segments(tokenizer, end_id, cache_cuts), SCHEMA)
    with small_batches(docs.sparkSession, "16m"):
        segments.write.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def _before(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one sum a part, and there are as many parts as files."""
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    total, out = 0, {}
    for part, n in sorted(map(tuple, sums)):
        out[part] = total
        total += n
    return out


def index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of every document; ``start`` counts the ids of all documents before it.  No ids are read."""
    before = spark.createDataFrame(list(_before(spark, path).items()), "part int, before long")
    segments = spark.read.schema(SCHEMA).parquet(path).join(before, "part")
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array("n_ids"))
    docs = segments.select((F.col("before") + F.col("first")).alias("base"), F.explode(F.arrays_zip("doc_ids", "starts", ends.alias("ends"))).alias("d"))
    return docs.select(F.col("d.doc_ids").alias("doc_id"), (F.col("base") + F.col("d.starts")).alias("start"), (F.col("d.ends") - F.col("d.starts")).alias("n_tokens"))


def _documents(before: dict[int, int], wanted: frozenset | None, keep_ids: bool):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, n_ids, doc_ids, starts, block_starts, blocks = (batch.column(i)[row] for i in range(batch.num_columns))
                doc_ids, base = doc_ids.as_py(), before[part.as_py()] + first.as_py()
                starts = np.append(starts.values.to_numpy(), n_ids.as_py())
                block_starts, blocks = block_starts.values.to_numpy(), blocks.as_buffer()
                for few in _runs([k for k, i in enumerate(doc_ids) if wanted is None or i in wanted], starts):
                    lo, hi = int(starts[few[0]]), int(starts[few[-1] + 1])
                    ids = unpack_blocks(blocks, block_starts[lo // BLOCK : -(-hi // BLOCK)])[lo % BLOCK :]
                    own = [ids[starts[k] - lo : starts[k + 1] - lo].astype("<u4") for k in few]
                    columns = [
                        pa.array([doc_ids[k] for k in few], pa.int64()),
                        pa.array([base + int(starts[k]) for k in few], pa.int64()),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                        pa.array([x.astype(np.int64) if keep_ids else None for x in own], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def _runs(at: list[int], starts: np.ndarray) -> Iterator[list[int]]:
    """Documents that follow each other, a bounded number of ids together unless one alone has more."""
    run: list[int] = []
    for k in at:
        if run and (k != run[-1] + 1 or starts[k + 1] - starts[run[0]] > SEGMENT // 4):
            yield run
            run = []
        run.append(k)
    if run:
        yield run


def read_ids(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` read back from the files: of all documents or of those named.

    For named documents only the blocks that hold them are unpacked, of segments whose index names one.  ``ids_crc32``
    is that of the ids as unsigned 32-bit integers; ``ids`` is null without ``keep_ids``.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)
    if doc_ids is not None:
        segments = segments.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in doc_ids]).cast("array<long>")))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    return segments.mapInArrow(_documents(_before(spark, path), wanted, keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
