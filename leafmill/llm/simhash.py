"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two that differ in at most `distance` bits are linked. Cut into
ceil((distance + 1) / 2) segments, one segment of a linked pair differs by at most one bit. So
each different fingerprint is indexed under every segment, whole and with each bit in turn left
out (one-wildcard variants). Linked fingerprints meet in a bucket: under the whole segment where
it is equal, under the variant without the one bit where it differs, and there on opposite sides
of that bit. Buckets are joined by equality of their keys, and the rest of the bits is verified.

Only different fingerprints are indexed, so exact copies cost nothing. Keys that one fingerprint
alone has are dropped before anything is gathered. A bucket of many fingerprints is cut into
chunks, and every pair of chunks is a task's group of bounded size, so a hot bucket is spread out;
of a group's links only a spanning forest leaves the task. Components grow by smallest label
with pointer jumping, on written tables, until nothing changes.

Contract for odd input: a null or empty text has no shingles and fingerprint zero, linked like any other;
rows that repeat a doc_id each get a row and are one another's links only by fingerprint; an
empty table gives an empty result; a null doc_id names no component but its row is kept, in the
component of the others of its fingerprint; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Fingerprints of a bucket that one group holds at most.
CHUNK = 2048


def fingerprint(text: str, words: int = WORDS) -> int:
    """Signed 64 bits: bit b is set if it is in over half of the shingles' hashes."""
    # bytes.split() cuts at exactly the bytes 0x20 and 0x09 to 0x0D; lower() is A-Z alone
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits, each set if it is in over half of the hashes."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""
    storage.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, fp long")


def segments(distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: so few that one differs by at most one bit."""
    n = -(-(distance + 1) // 2)
    edges = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """A row per fingerprint, segment and variant: slot names segment and wildcard, key is the
    segment without that bit, side the bit that was left out (null under the whole segment)."""
    made = []
    for s, (first, width) in enumerate(segments(distance)):
        mask = (1 << width) - 1
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))
        made.append(F.struct(F.lit(s * 128).alias("slot"), part.alias("key"), F.lit(None).cast("int").alias("side")))
        for b in range(width):
            bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
            made.append(
                F.struct(F.lit(s * 128 + 1 + b).alias("slot"), part.bitwiseAND(F.bitwise_not(bit)).alias("key"), F.shiftrightunsigned(part, b).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("side"))
            )
    return fps.select("fp", F.inline(F.array(*made)))


def meeting(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The variants (slot, key, side, fp) under which some fingerprints may be linked, and how many are there (n). fps: distinct fingerprints in a column fp."""
    # few bytes make many rows and much work here: a fingerprint has some 70 rows of 40 bytes
    parts = storage.partitions_for(fps, factor=350)
    index = variants(fps.repartition(parts, "fp"), distance)
    # keys that can link anything: a whole segment twice, or both sides of a left-out bit
    sizes = index.groupBy("slot", "key").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("n_one"), F.max(F.col("side").isNull()).alias("whole"))
    worth = sizes.filter((F.col("n") > 1) & (F.col("whole") | ((F.col("n_one") > 0) & (F.col("n_one") < F.col("n")))))
    return index.join(storage.materialize(worth.select("slot", "key", "n"), "simhash_buckets"), ["slot", "key"])


def links(fps: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of different fingerprints within distance; every linked pair is connected by
    some of them, and none is beyond distance. fps: distinct fingerprints in a column fp."""
    parts = storage.partitions_for(fps, factor=350)
    met = meeting(fps, distance)
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # chunk i meets every chunk j: the group is named by the smaller and the larger
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("slot", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "side", "fp")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group, distance), columns=["a", "b"])

    return met.repartition(parts, "slot", "key", "i", "j").groupBy("slot", "key", "i", "j").applyInPandas(verify, "a long, b long").distinct()


def _forest(group: pd.DataFrame, distance: int) -> np.ndarray:
    """Links that span the components of one group."""
    fp = group["fp"].to_numpy(np.int64).view(np.uint64)
    side = group["side"].to_numpy(np.float64)
    n = len(fp)
    label = np.arange(n)
    out = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    whole = np.isnan(side).all()
    left = np.arange(n) if whole else np.flatnonzero(side == 0)
    right = np.arange(n) if whole else np.flatnonzero(side == 1)
    for x in left.tolist():
        to = right[right > x] if whole else right
        near = to[np.bitwise_count(fp[to] ^ fp[x]) <= distance]
        for y in near.tolist():
            a, b = root(x), root(y)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((x, y))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    signed = fp.view(np.int64)
    return np.stack([signed[pairs[:, 0]], signed[pairs[:, 1]]], axis=1)


def components(pairs: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root): the smallest node that each node of pairs (a, b) can reach.

    Rounds of two steps: a node takes the smallest label among its neighbours and itself, then
    the label of its label. Each round is a written table; one number per round tells whether anything changed.
    """
    edges = storage.materialize(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{name}_edges")
    labels = storage.materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}_labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        # what hangs on a root follows it to the smallest label that any of its nodes has seen
        best = low.groupBy("was").agg(F.min("root").alias("best"))
        hung = low.join(best, "was").select("node", "was", F.least("root", "best").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = storage.materialize(hung.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root")), f"{name}_labels")
        changed = new.filter("root <> was").limit(1).count()
        storage.drop(labels)
        labels = new.select("node", "root")
        if not changed:
            storage.drop(edges)
            return labels


def grouped(first: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """first (fp, ...), a row per fingerprint, with root: the smallest fingerprint that it can reach."""
    roots = components(links(first.select("fp"), distance)).withColumnRenamed("node", "fp")
    return first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """A row per document: doc_id, fp, component_id, which is the smallest doc_id that is reachable."""
    found = storage.materialize(fingerprints(docs, words), "simhash_fingerprints")
    first = storage.materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash_first")
    linked = grouped(first, distance)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = linked.join(smallest, "root").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def text_name(text: str = "text") -> Column:
    """A text by its digest; null is empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def rows_named(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, id, node): whole rows of docs, one for each (id, node) of wanted. Whatever columns docs has are inside row."""
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_name().alias("node"))
    wanted = wanted.select(F.col("id").alias("wanted_id"), F.col("node").alias("wanted_node"))
    # by doc_id too, so that copies of one text are not dealt to one task
    return held.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("node") == F.col("wanted_node")), "left_semi").dropDuplicates(["id", "node"])


def keep_first(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """One row of docs for each group of near-duplicates, with the columns it had: the smallest
    doc_id (null last), and of rows that share it the smallest text digest. Groups are those of
    the texts, so rows that repeat a doc_id with other texts are groups of their own. Texts stay
    where they are until the rows that stay are known."""
    storage.bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["id", "node", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_name().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    found = rows.mapInArrow(of, "id long, node string, fp long").groupBy("fp").agg(F.min(own).alias("own"))
    best = grouped(storage.materialize(found, "simhash_first"), distance).groupBy("root").agg(F.min("own").alias("own"))
    return rows_named(docs, best.select("own.id", "own.node")).select("row.*")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
