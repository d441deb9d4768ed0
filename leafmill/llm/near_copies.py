"""SimHash near-dedup of texts of 5-word Jaccard similarity 0.8 or more, exact in what it links.

Candidates meet in buckets. A fingerprint of the 5-word shingles is indexed under op2's one-wildcard segment
variants, as there, so all texts whose fingerprints differ in at most three bits meet. But at similarity 0.8 two
fingerprints of 64 bits differ in some 10 bits and often in more, and segments for that distance
would be of about seven bits, which tell nothing apart: their buckets would grow with the square of
the corpus. So the texts beyond three bits meet by banded minima: a set of shingle hashes gives 120 minima
in 24 bands of five, and texts that agree in a whole band share a bucket, which a pair of similarity s does with probability
1 - (1 - s^5)^24: 0.9999 at 0.8 and more above it. Whatever meets is compared by its
whole sets, so nothing below the similarity is linked.

Only different texts are indexed, so exact copies cost nothing. Buckets with the same members are
verified once. A large bucket is cut into chunks by texts and by shingles, every pair of chunks is
a task's group of bounded size, and of a group's links only a spanning forest leaves the task.

Contract for odd input: a null or empty text has no shingles and is linked to others that have none; a
text of under five words is one shingle; a null doc_id is last of its group; rows that repeat leave one; an
empty table gives an empty result; columns other than doc_id and text are carried whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, storage

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, IN_BAND = 24, 5
#: Texts and shingles of a bucket that one chunk holds, in expectation.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000

_DRAWN = np.random.default_rng(SEED)
_MASKS = _DRAWN.integers(0, 1 << 64, (BANDS * IN_BAND, 1), np.uint64)
_ODD = _DRAWN.integers(0, 1 << 64, (BANDS * IN_BAND, 1), np.uint64) | np.uint64(1)
_BAND = _DRAWN.integers(0, 1 << 64, BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes_of(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; words are cut and lowered as in simhash."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())], np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The different ones, rising; a zero stands for none."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band."""
    low = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, ((hashes[None, at : at + 2048] ^ _MASKS) * _ODD).min(axis=1), out=low)
    key = _BAND.copy()
    for minimum in low.reshape(BANDS, IN_BAND).T:
        key = (key ^ minimum) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _first(docs: DataFrame, words: int) -> DataFrame:
    """A row per different text: node, own (its smallest doc_id), n (shingles), fp, bands."""
    storage.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [hashes_of(x, words) for x in batch.column(2).to_pylist()]
            sets = [shingle_set(x) for x in every]
            fps = pa.array([simhash.majority(x) for x in every], pa.int64())
            keys = np.concatenate([band_keys(x) for x in sets]) if sets else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), fps, bands], ["id", "node", "n", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), simhash.text_name().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(of, "id long, node string, n long, fp long, bands array<long>")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    return rows.withColumn("own", own).groupBy("node").agg(F.min("own").alias("own"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))


def links(docs: DataFrame, first: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Pairs (a, b) of nodes of at least that similarity, a spanning forest of each bucket's."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = first.repartition(parts, "node").select("node", "n", F.explode("bands").alias("key"))
    # texts of one fingerprint meet outright, those of linked ones under a variant
    near = storage.materialize(simhash.meeting(first.select("fp").distinct()).select(F.xxhash64("slot", "key", F.lit("variant")).alias("key"), "fp"), "near_copies_variants")
    same = first.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("fp", F.lit("same")).alias("key"), "fp")
    by_bits = near.unionByName(same).join(first.select("fp", "node", "n"), "fp").select("node", "n", "key")

    def sized(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("texts > 1")

    sizes = sized(index).unionByName(sized(by_bits))
    index = index.unionByName(by_bits)
    worth = sizes.groupBy("texts", "total", "members").agg(F.min("key").alias("key"))
    chunks = F.greatest(F.ceil(F.col("texts") / chunk), F.ceil(F.col("total") / chunk_shingles)).cast("int")
    met = storage.materialize(index.join(worth.select("key", chunks.alias("chunks")), "key").select("key", "node", "chunks"), "near_copies_met")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(hashes_of(x, words)).tobytes() for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["node", "hashes"])

    wanted = first.join(met.select("node").distinct(), "node", "left_semi").select("own.id", "node")
    texts = simhash.rows_named(docs.select("doc_id", "text"), wanted).select("node", F.coalesce("row.text", F.lit("")).alias("text"))
    sets = storage.materialize(texts.mapInArrow(hashed, "node string, hashes binary"), "near_copies_sets")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # chunk i meets every chunk j: the group is named by the smaller and the larger
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node").join(sets, "node")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group, similarity), columns=["a", "b"], dtype=str)

    return met.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(verify, "a string, b string").distinct()


def _forest(group: pd.DataFrame, similarity: float) -> list[tuple[str, str]]:
    """Links that span the components of one group."""
    nodes, own = group["node"].tolist(), group["own"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    held = np.zeros(1 + max(int(x.max()) for x in codes), bool)
    label = np.arange(len(nodes))
    one = group["i"].iloc[0] == group["j"].iloc[0]
    left = np.arange(len(nodes)) if one else np.flatnonzero(own == group["i"].iloc[0])
    right = np.arange(len(nodes)) if one else np.flatnonzero(own == group["j"].iloc[0])
    out = []
    for x in left.tolist():
        to = right[right > x] if one else right
        fits = np.minimum(sizes[to], sizes[x]) / np.maximum(sizes[to], sizes[x]) >= similarity
        to = to[fits & (label[to] != label[x])]
        if not len(to):
            continue
        held[codes[x]] = True
        for y in to.tolist():
            if label[x] == label[y]:
                continue
            both = int(np.count_nonzero(held[codes[y]]))
            if both / (sizes[x] + sizes[y] - both) >= similarity:
                label[label == label[y]] = label[x]
                out.append((nodes[x], nodes[y]))
        held[codes[x]] = False
    return out


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of near copies, with the columns it had: the smallest doc_id
    (null last), and of rows that share it the smallest text hash. Groups are those of the
    texts, so rows that repeat a doc_id with other texts are groups of their own."""
    first = storage.materialize(_first(docs, words), "near_copies_first")
    roots = simhash.components(links(docs, first, words, similarity), "near_copies").withColumnRenamed("root", "linked")
    grouped = first.select("node", "own").join(roots, "node", "left").withColumn("root", F.coalesce("linked", "node"))
    best = grouped.groupBy("root").agg(F.min("own").alias("own")).select("own.id", "own.node")
    return simhash.rows_named(docs, best).select("row.*")
