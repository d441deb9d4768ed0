"""Byte-level BPE in two tiers.

Tier one is a minimal perfect hash over the vocabulary's byte strings: a pre-token that is a
vocabulary entry gets its rank from one probe. Tier two, for all other pre-tokens, merges linked
bytes with a heap of (rank, place), lowest rank first and leftmost among equals. Decoding is a
look-up by id. Pieces that a worker has met before come from a bounded memory.

Contract for odd input: a null text is an empty one, with no ids; rows that repeat are encoded
each by itself; an empty table gives an empty result; columns other than doc_id and text are not
read; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .pieces import PieceEncoder


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a base64 byte string and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_WORD = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one probe and one comparison."""

    def __init__(self, keys: Sequence[bytes], per_bucket: int = 2):
        self._n = n = len(keys)
        self._m = m = max(1, n // per_bucket)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for k in keys:
            h = xxhash.xxh3_128_intdigest(k)
            buckets[h % m].append((h, k))
        shift, taken = [0] * m, bytearray(n)
        self.keys: list[bytes] = [b""] * n
        for b in (b for b in sorted(range(m), key=lambda i: -len(buckets[i])) if len(buckets[b]) > 1):
            group, d = buckets[b], 0
            while True:
                at = [self._slot(h, d) for h, _ in group]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                d += 1
            shift[b] = d
            for x, (_, k) in zip(at, group):
                taken[x] = 1
                self.keys[x] = k
        # what is free is named outright for the keys that are alone in their bucket
        free = (x for x in range(n) if not taken[x])
        for b, group in enumerate(buckets):
            if len(group) == 1:
                at = next(free)
                shift[b] = -1 - at
                self.keys[at] = group[0][1]
        self._shift = shift

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 64) + d * 0x9E3779B97F4A7C15) & _WORD
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _WORD
        return (x ^ x >> 32) % self._n

    def find(self, key: bytes) -> int:
        """The slot of key; -1 if it is no key."""
        if not self._n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        d = self._shift[h % self._m]
        at = -1 - d if d < 0 else self._slot(h, d)
        return at if self.keys[at] == key else -1


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of word's parts after all merges."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        # stale unless the two parts still stand as they did
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0:
            r = ranks.get(word[j:stop])
            if r is not None:
                heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; `split` matches pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], split: str, table: PerfectHash | None = None):
        self.ranks = ranks
        self.table = table or PerfectHash(list(ranks))
        self._rank_at = [ranks[k] for k in self.table.keys]
        # white space as Unicode has it, without the separators that Python adds
        self._split = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.parts = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.parts[r] = k

    def encode_one(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self._split.findall(text):
            raw = x.encode()
            at = self.table.find(raw)
            if at >= 0:
                out.append(self._rank_at[at])
            else:
                out += merge_bytes(raw, self.ranks)
        return out

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        for x in texts:
            yield np.array(self.encode_one(x), dtype="<u4").tobytes()

    def encoder(self) -> PieceEncoder:
        return PieceEncoder(self.encode_many, keep_space=True)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))


_KEPT: dict[tuple[str, str], tuple[Codec, PieceEncoder, list[str]]] = {}


def encode_documents(docs: DataFrame, rank_file: str, split: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    The vocabulary and its hash are built once and broadcast; their size is that of the rank file.
    """
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    ranks = read_ranks(rank_file)
    sent = spark.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process keeps its codec, and what that remembers, from task to task
        if (rank_file, split) not in _KEPT:
            _KEPT.clear()
            codec = Codec(sent.value[0], split, sent.value[1])
            _KEPT[rank_file, split] = codec, codec.encoder(), list(map(str, range(len(codec.parts))))
        codec, encoder, names = _KEPT[rank_file, split]
        for batch in batches:
            n, listed, decoded, kept = [], [], [], []
            for raw in encoder.encode(batch.column(1).to_pylist()):
                own = np.frombuffer(raw, "<u4")
                one = own.tolist()
                n.append(len(one))
                listed.append(hashlib.sha256(",".join(map(names.__getitem__, one)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(one)).hexdigest())
                if ids:
                    kept.append(own.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
