"""Packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of the longest length as fit and then one piece
for each bit of the rest, longest first. Every piece is a sequence by itself, its length a power
of two, so no sequence crosses documents and none needs padding. Sequences of equal length form a
bucket: a sequence_id is the bucket's number, then the task's, then a count within both, so ids
of a bucket are neighbours and a batch of one shape is one id range. Nothing is shuffled.

Contract for odd input: a null text is an empty one and has just the end id; documents with the
same doc_id are packed each by itself; an empty table gives no pieces; columns other than doc_id
and text are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .pieces import library_encoder

LONGEST = 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, longest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST, ids: bool = True) -> DataFrame:
    """A row per piece: its place in its document and sequence, ids_crc32, and the ids if asked for."""
    if longest < 1 or longest & (longest - 1) or longest > 1 << 20:
        raise ValueError("the longest sequence has to be a power of two, at most 2**20")
    storage.bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, used = library_encoder(tokenizer, keep_space=False), [0] * longest.bit_length()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for name, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                x += end
                start, n = 0, len(x) // 4
                for k in lengths(n, longest):
                    bucket = k.bit_length() - 1
                    piece = x[4 * start : 4 * (start + k)]
                    row = (name, start, k, n, bucket << 58 | part << 32 | used[bucket], 0, zlib.crc32(piece))
                    for column, value in zip(out, row):
                        column.append(value)
                    if ids:
                        out[7].append(np.frombuffer(piece, "<i4"))
                    used[bucket] += 1
                    start += k
            columns = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids_crc32 long" + ", ids array<int>" * ids)
