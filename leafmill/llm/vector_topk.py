"""Exact top-k inner products by norm buckets.

Candidates are written once, grouped by length (bucket k holds norms from RATIO**k to RATIO**(k+1)),
the longest first. Every query gets a first bound t on its k-th best score, from its products with the SEEDS
longest vectors; no candidate shorter than t / |q| can matter to it. Queries go in rounds by that
length, so a round reads the buckets from its shortest useful length up, and no others (the file
statistics of the norm skip the rest).

Within a round, a bucket whose longest vector has norm m can only matter to a query where the cosine
reaches the local threshold c = t / (|q| m), t being its running k-th best score. Above 1 the bucket is skipped; from COORDINATE on,
candidates are cut to those inside the range that c allows in the query's largest coordinates;
below, to those long enough (norm >= t / |q|). What is left gets its exact integer product.

A round has a fixed number of queries, so what is broadcast and what the driver holds at a time have a proven bound;
its result, k rows per query, is a written table, and its broadcast is released before the next one.

Contract for odd input: rows with a null id, a null vector, or null or non-finite components take no part;
a vector is compared with vectors of the same length only; a query is never compared with rows of
its own id; repeated query rows count once, and different vectors of one id are queries of their own, each with its
ranks; equal scores go to the smaller id, and repeated candidate rows
each take a place; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

RATIO = 1.25
#: Local threshold from which coordinates are looked at, and how many.
COORDINATE, FOCUS = 0.7, 3
#: Queries of one round, and coordinates of their vectors at most: what a broadcast holds.
ROUND_ROWS, ROUND_NUMBERS = 16_384, 1 << 23
#: Longest vectors that first bounds come from.
SEEDS = 4096
CHUNK = 256
#: Products below this are exact in floating point.
_EXACT = float(1 << 53)
#: Stands for no score; products are larger.
NONE = -(1 << 62)


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id and components floor(scale * x), x as double; rows that take no part are left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("v"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of q and c."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < _EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**61:
        return q @ c.T
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


class _Best:
    """The k best of every query so far: scores and ids, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        n = len(ids)
        self.score = np.full((n, k), NONE)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)
        self.bound = np.full(n, -np.inf)
        unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.unit = unit

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: of queries `rows` against candidates `ids`; the least integer marks what is out."""
        s = np.hstack([self.score[rows], scores])
        v = np.hstack([self.vec[rows], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((v, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.vec[rows] = np.take_along_axis(v, order, 1)
        kth = self.score[rows, -1].astype(np.float64)
        kth[self.score[rows, -1] == NONE] = -np.inf
        self.bound[rows] = np.maximum(self.bound[rows], kth)

    def scan(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Candidates of one chunk, all of one norm bucket."""
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        longest = norm.max(initial=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.norm * longest > 0, self.bound / (self.norm * longest), np.where(self.bound > 0, np.inf, -np.inf))
        for rows, coordinate in ((np.flatnonzero((local <= 1 + 1e-9) & (local >= COORDINATE)), True), (np.flatnonzero(local < COORDINATE), False)):
            if not len(rows):
                continue
            may = self._by_coordinate(rows, local[rows], v, norm) if coordinate else self._by_length(rows, norm)
            use = np.flatnonzero(may.any(0))
            some = may[:, use].any(1)
            rows, may = rows[some], may[some][:, use]
            if len(rows) and len(use):
                scores = _products(self.v[rows], v[use])
                scores[~may | (scores < self.bound[rows][:, None]) | (ids[use][None, :] == self.ids[rows][:, None])] = NONE
                hit = (scores > NONE).any(1)
                if hit.any():
                    self.add(rows[hit], ids[use], scores[hit])

    def _by_length(self, rows: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self.norm[rows][:, None] * norm[None, :] * (1 + 1e-9) >= self.bound[rows][:, None]

    def _by_coordinate(self, rows: np.ndarray, local: np.ndarray, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """A unit vector with cosine c or more to q lies within q_f c -+ sqrt((1-q_f^2)(1-c^2)) at coordinate f."""
        unit = v / np.maximum(norm, 1e-300)[:, None]
        c = np.minimum(local, 1.0)
        may = self._by_length(rows, norm)
        for j in range(self.focus.shape[1]):
            f = self.focus[rows, j]
            at = self.unit[rows, f]
            wide = np.sqrt(np.maximum(0, 1 - at**2) * np.maximum(0, 1 - c**2)) + 1e-7
            x = unit[:, f].T
            low, high = at * c - wide, at * c + wide
            # beyond the range the cosine of a longer reach still counts: |q_f| itself is inside
            high = np.where(at >= c, 1.0, high)
            low = np.where(at <= -c, -1.0, low)
            may &= (x >= low[:, None]) & (x <= high[:, None])
        return may


def _by_dimension(ids: np.ndarray, vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(x) for x in vectors])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield ids[at], np.array([vectors[i] for i in at], np.int64).reshape(len(at), d)


def _norm_buckets(ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of one norm bucket each, longest bucket first."""
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    bucket = np.floor(np.log(np.maximum(norm, 0.5)) / np.log(RATIO)).astype(int)
    for b in np.unique(bucket)[::-1]:
        at = np.flatnonzero(bucket == b)
        at = at[np.argsort(-norm[at], kind="stable")]
        for i in range(0, len(at), CHUNK):
            yield ids[at[i : i + CHUNK]], v[at[i : i + CHUNK]]


def top_products(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    vectors: as integer_vectors gives them. is_query: a condition on vec_id.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bucket = F.floor(F.log(F.greatest(F.col("norm"), F.lit(0.5))) / float(np.log(RATIO))).cast("int")
    rows = vectors.select("vec_id", "v", norm.alias("norm")).withColumn("bucket", bucket)
    parts = storage.partitions_for(vectors)
    # by length over all files, and inside each; the hash spreads a bucket that many vectors share
    grouped = rows.repartitionByRange(parts, F.desc("bucket"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("norm"))
    candidates = storage.materialize(grouped, "topk_candidates")
    dim = max(1, candidates.agg(F.max(F.size("v"))).first()[0] or 1)
    most = max(1, min(ROUND_ROWS, ROUND_NUMBERS // dim))
    queries = candidates.filter(is_query).select("vec_id", "v").distinct()
    bounded = storage.materialize(_first_bounds(candidates, queries, k, min(SEEDS, most)), "topk_queries")
    total = bounded.count()
    rounds = -(-total // most)
    if rounds > 1:
        ordered = bounded.repartitionByRange(rounds, F.desc("need"), F.xxhash64("vec_id")).withColumn("round", F.spark_partition_id())
        bounded = storage.materialize(ordered, "topk_rounds")
    paths = []
    for r in range(rounds):
        held = (bounded.filter(F.col("round") == r) if rounds > 1 else bounded).orderBy(F.desc("need"), "vec_id", "v")
        paths += _round(candidates, held.select("vec_id", "v", "bound", "need"), k, most)
    shape = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def _first_bounds(candidates: DataFrame, queries: DataFrame, k: int, seeds: int) -> DataFrame:
    """queries with bound, below which no score is wanted (null: none known), and need, the least norm that can give it."""
    spark = candidates.sparkSession
    held = candidates.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "v").collect()
    sent = spark.sparkContext.broadcast({v.shape[1]: (ids, v) for ids, v in _by_dimension(np.array([x[0] for x in held], np.int64), [x[1] for x in held])})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in _by_dimension(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()):
                other, seed = sent.value.get(v.shape[1], (np.zeros(0, np.int64), np.zeros((0, v.shape[1]), np.int64)))
                scores = _products(v, seed)
                scores[ids[:, None] == other[None, :]] = NONE
                bound = np.partition(scores, -k, axis=1)[:, -k] if len(other) >= k else np.full(len(ids), NONE)
                norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                need = np.where(bound > 0, bound / np.maximum(norm, 1e-300) * (1 - 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v), pa.list_(pa.int64())), pa.array(bound, pa.int64(), mask=bound == NONE), pa.array(need)], ["vec_id", "v", "bound", "need"])

    return queries.mapInArrow(of, "vec_id long, v array<long>, bound long, need double")


def _round(candidates: DataFrame, queries: DataFrame, k: int, most: int) -> list[str]:
    """Paths of the results of one round, in parts of at most `most` queries."""
    spark, paths = candidates.sparkSession, []
    # a round is as large as its bound on average; what is over goes in a part of its own
    held = queries.collect()
    for at in range(0, len(held), most):
        part = held[at : at + most]
        best = {}
        for number, v in _by_dimension(np.arange(len(part)), [x[1] for x in part]):
            ids = np.array([part[i][0] for i in number], np.int64)
            bound = np.array([-np.inf if part[i][2] is None else part[i][2] for i in number], np.float64)
            best[v.shape[1]] = (number, ids, v, bound)
        sent = spark.sparkContext.broadcast(best)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states = {}
            for d, (_, ids, v, bound) in sent.value.items():
                states[d] = _Best(ids, v, k)
                states[d].bound = bound.copy()
            for batch in batches:
                for ids, v in _by_dimension(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()):
                    if v.shape[1] in states:
                        for a, b in _norm_buckets(ids, v):
                            states[v.shape[1]].scan(a, b)
            for d, s in states.items():
                i, j = np.nonzero(s.score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][i]), pa.array(s.ids[i]), pa.array(s.vec[i, j]), pa.array(s.score[i, j])], ["number", "query_id", "vec_id", "score"])

        useful = candidates.filter(F.col("norm") >= min(x[3] for x in part)).select("vec_id", "v")
        local = useful.mapInArrow(search, "number long, query_id long, vec_id long, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        path = storage.new_path(spark, "topk_round")
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(path)
        paths.append(path)
        sent.destroy()
    return paths
