"""Token-id files: fixed-width bit packing in blocks.

An id takes the least bits that hold the largest id of the vocabulary. A block is

    magic b"TIDB" | u8 version | u8 bits | u16 zero | u32 documents | u64 ids |
    u64 first position | u64 offsets[documents + 1] | packed ids, low bit first

``offsets`` are in ids from the block's start, so one document or one range of ids can be cut
out and unpacked alone. Blocks are rows of a Parquet table (block bytes, with the doc_ids they
hold and their range), so Spark's commit protocol makes the files whole or absent, any store
that Spark can write holds them, and ``first_doc_id``/``last_doc_id`` prune row groups.

Contract for odd input: a null text is an empty one and has just the end id; documents with the
same doc_id are each written, next to one another, in order of their text; an empty table gives
no blocks; columns other than doc_id and text are not read. A null doc_id sorts first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .pieces import library_encoder, vocabulary_of

MAGIC, VERSION = b"TIDB", 1
_HEAD = struct.Struct("<4sBBHIQQ")
#: Ids after which a block ends.
BLOCK_IDS = 1 << 18

BLOCKS = "part int, block int, first_doc_id long, last_doc_id long, doc_ids array<long>, ids_before long, n_ids long, bytes binary"


def bits_for(vocabulary: int) -> int:
    """Least bits for ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, low bit first; an id that does not fit is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw, bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the id at start on; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, start * bits // 8).astype("<u4")
    first, skip = divmod(start * bits, 8)
    last = -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8, last - first, first), bitorder="little")[skip : skip + n * bits]
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat.reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def write_block(docs: list[bytes], bits: int, first: int) -> bytes:
    """docs: each one's ids as little-endian unsigned 32-bit bytes. first: ids before this block."""
    offsets = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(x) // 4 for x in docs], out=offsets[1:])
    ids = np.frombuffer(b"".join(docs), "<u4")
    return _HEAD.pack(MAGIC, VERSION, bits, 0, len(docs), len(ids), first) + offsets.tobytes() + pack(ids, bits)


class Block:
    """Random access to a block's documents."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, _, self.n_docs, self.n_ids, self.first = _HEAD.unpack_from(raw)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a block of token ids")
        self.offsets = np.frombuffer(raw, "<u8", self.n_docs + 1, _HEAD.size).astype(np.int64)
        self._packed = memoryview(raw)[_HEAD.size + 8 * (self.n_docs + 1) :]

    def ids(self, start: int, n: int) -> np.ndarray:
        return unpack(self._packed, self.bits, start, n)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int | None = None, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every document, append end_id, and write blocks in ascending doc_id order to path.

    vocabulary: ids lie below it; the tokenizer's own size, if not given. One range exchange orders the documents; each task then writes its own blocks in a stream and
    holds one block at a time. ids_before counts from the task's first document.
    """
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    bits, end = bits_for(max(end_id + 1, vocabulary or vocabulary_of(tokenizer))), np.array([end_id], "<u4").tobytes()

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        encoder = library_encoder(tokenizer, keep_space=True)
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def take() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([min((x for x in names if x is not None), default=None)], pa.int64()), pa.array([max((x for x in names if x is not None), default=None)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([write_block(ids, bits, before)], pa.binary())],
                ["part", "block", "first_doc_id", "last_doc_id", "doc_ids", "ids_before", "n_ids", "bytes"],
            )

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids.append(x + end)
                names.append(name)
                held += len(x) // 4 + 1
                if held >= BLOCK_IDS:
                    yield take()
                    block, before, held = block + 1, before + held, 0
                    ids, names = [], []
        if names:
            yield take()

    n = partitions or storage.partitions_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(to_blocks, BLOCKS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """The blocks with `start`, the ids of all blocks before each; blocks are told apart by (part, block).

    Only a number for each writing task is summed over the whole, so its size is that of the
    task list and not of the data.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before, rows = 0, []
    for part, n in sums:
        rows.append((part, before))
        before += n
    base = spark.createDataFrame(rows, "part int, base long")
    return blocks.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("ids_before"))


def token_digests(blocks: DataFrame) -> DataFrame:
    """A row per document, from the packed ids: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, raw, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                block = Block(raw)
                data, at = block.ids(0, block.n_ids).astype("<u4").tobytes(), block.offsets
                ends = (at * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("doc_ids", "bytes", "start").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
