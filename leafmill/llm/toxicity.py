"""Toxicity by nearest labelled examples.

A text is a unit vector over every word of the labelled examples, and over those word beginnings of
three to six letters that tell the labels apart. A component is (1 + log tf) * idf * (FLOOR +
evidence): evidence is the shrunken log-odds of the labels where a likelihood-ratio test over all
terms finds any, and zero elsewhere, so a word that says nothing still counts a little and every
text that shares a word with an example has neighbours. (Without that factor two texts' chance
words outweigh what sets the labels apart; the README has figures for both.)

The k examples of highest cosine are found exactly in an inverted index with block maxima. The
examples lie in blocks. Short lists are summed outright, which gives each block's exact largest
share from them; long lists are stored by block, with the largest weight that each block has. Both together bound a
block's cosines. A text's two blocks of highest bound are scored first, and then each block whose
bound reaches the k-th best cosine by then; the others are never looked at. Neighbours vote with
their nearness, and an isotonic fit on the examples themselves (each left out in turn) makes the
vote a probability. The neighbours are the evidence.

One bound, a documented parameter: EXAMPLES labelled rows in expectation, up to half of them of
label 1; every term of those counts, and the fit weighs each label's rows by how many of them were
left out. So what is broadcast does not grow with the corpus. Every text is scored whole.

Contract for odd input: a null or empty text, and one without a word of the examples, has no
neighbours and gets the share of label 1; labels other than 0 and 1 are not used, of several
labels of one doc_id the largest counts, and of several texts the smallest is the example; without examples every score
is 0; equal cosines go to the example of the smaller doc_id; rows that repeat are scored alike; an empty table
gives an empty result; columns other than doc_id and text (doc_id and toxic of the labels) are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .holdout import held_out

EXAMPLES = 6_000
K, BLOCK, THRESHOLD = 15, 64, 0.3
#: Weight of a term that tells nothing, and examples of the average label that log-odds are shrunk by.
FLOOR, SHRINK = 0.02, 5.0
#: Letters of the word beginnings that are terms.
HEAD, LONGEST = 3, 6
#: A list with over one example in so many is stored by block; texts that are searched at once.
DENSE, GROUP = 16, 64

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def number(term: str) -> int:
    """A term's name in the index."""
    return xxhash.xxh64_intdigest(term.encode()) >> 1


def beginnings(word: str) -> list[str]:
    """Marked by a hyphen, which no word has."""
    return [word[:n] + "-" for n in range(HEAD, min(LONGEST, len(word) - 1) + 1)]


class BlockMaxIndex:
    """Inverted index of rows of non-negative weights. rows: (row, term, weight) arrays, terms below size. Of equal products the row with the smaller `prefer` goes first,
    by default its number."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, size: int, block: int = BLOCK, prefer: np.ndarray | None = None):
        self.n, self.block = n, block
        self.prefer = np.arange(n) if prefer is None else prefer
        self.n_blocks = max(1, -(-n // block))
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        long = np.bincount(term, minlength=size) > n / DENSE
        self.dense_of = np.where(long, np.cumsum(long) - 1, -1)
        inside = long[term]
        # by block and list, so that a block's part of all long lists is one matrix
        self.dense = np.zeros((self.n_blocks, int(long.sum()), block))
        self.dense[row[inside] // block, self.dense_of[term[inside]], row[inside] % block] = weight[inside]
        self.best = self.dense.max(axis=2).T.copy()
        self.row, self.weight = row[~inside].astype(np.int32), weight[~inside]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[~inside], minlength=size))])

    def top(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the (scores, rows) of the k highest products above 0, ties to the row that is preferred."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cut = np.searchsorted(owner, np.arange(0, texts + GROUP, GROUP))
        for g, a, z in zip(range(0, texts, GROUP), cut.tolist(), cut[1:].tolist()):
            m = min(GROUP, texts - g)
            out += self._group(owner[a:z] - g, term[a:z], weight[a:z], m, k, None if without is None else without[g : g + m])
        return out

    def _group(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        at = self.dense_of[term]
        q = np.zeros((m, len(self.best)))
        q[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        owner, term, weight = owner[at < 0], term[at < 0], weight[at < 0]
        first, size = self.start[term], self.start[term + 1] - self.start[term]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        width = self.n_blocks * self.block
        score = np.bincount(np.repeat(owner * width, size) + self.row[at], np.repeat(weight, size) * self.weight[at], m * width).astype(np.float64, copy=False).reshape(m, self.n_blocks, self.block)
        bound = score.max(axis=2) + q @ self.best
        if without is not None:
            score[np.arange(m), without // self.block, without % self.block] = -np.inf
        done = np.zeros(bound.shape, bool)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                who = np.flatnonzero(wanted[:, b])
                score[who, b] += q[who] @ self.dense[b]
            done[wanted] = True

        first = np.argsort(-bound, axis=1, kind="stable")[:, :2]
        seeds = np.zeros(bound.shape, bool)
        np.put_along_axis(seeds, first, True, axis=1)
        visit(seeds)
        begun = score[np.arange(m)[:, None], first].reshape(m, -1)
        kth = np.partition(begun, -k, axis=1)[:, -k] if begun.shape[1] >= k else np.full(m, -np.inf)
        least = np.maximum(kth - 1e-9, 0)
        visit(~done & (bound > 0) & (bound >= least[:, None]))
        score[~done] = -np.inf
        out = []
        for i, flat in enumerate(score.reshape(m, -1)):
            near = np.flatnonzero((flat >= least[i]) & (flat > 0))
            if len(near) > 8 * k:
                own = flat[near]
                near = near[own >= np.partition(own, -k)[-k] - 1e-9]
            own = np.round(flat[near], 12)
            best = np.lexsort((self.prefer[near], -own))[:k]
            out.append((own[best], near[best]))
        return out


@dataclass
class Model:
    """terms: the names, rising; worth: of each term; heads: how kept beginnings start."""

    terms: np.ndarray
    worth: np.ndarray
    heads: frozenset[str]
    index: BlockMaxIndex | None = None
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    share: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    #: Terms of the words met so far: one term, -1 for none, or -2 - place in _several.
    _known: dict[str, int] = field(default_factory=dict)
    _several: list[list[int]] = field(default_factory=list)

    def _learn(self, words: set[str]) -> None:
        if len(self._known) > 400_000:
            self._known.clear()
            self._several.clear()
        fresh = [w for w in words if w not in self._known]
        asked, whose = [number(w) for w in fresh], list(range(len(fresh)))
        for i, w in enumerate(fresh):
            if w[:HEAD] in self.heads:
                own = beginnings(w)
                asked += map(number, own)
                whose += [i] * len(own)
        names = np.array(asked, np.int64)
        at = np.searchsorted(self.terms, names)
        hit = np.append(self.terms, -1)[at] == names
        found = np.where(hit, at, -1)[: len(fresh)].tolist()
        more: dict[int, list[int]] = {}
        for j in np.flatnonzero(hit[len(fresh) :]).tolist():
            i = whose[len(fresh) + j]
            more.setdefault(i, [found[i]] if found[i] >= 0 else []).append(int(at[len(fresh) + j]))
        for i, own in more.items():
            found[i] = -2 - len(self._several)
            self._several.append(own)
        self._known.update(zip(fresh, found))

    def vectors(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit vectors, by text and term."""
        counts = [words_of(x) for x in texts]
        flat = list(chain.from_iterable(counts))
        self._learn(set(flat))
        term = np.fromiter(map(self._known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        n = np.fromiter(chain.from_iterable(c.values() for c in counts), np.float64, len(flat))
        of_several = np.flatnonzero(term < -1).tolist()
        more = [(owner[i], t, n[i]) for i in of_several for t in self._several[-2 - term[i]]]
        one = term >= 0
        owner, term, n = owner[one], term[one], n[one]
        if more:
            own = np.array(more)
            owner, term, n = np.append(owner, own[:, 0].astype(np.int64)), np.append(term, own[:, 1].astype(np.int64)), np.append(n, own[:, 2])
        key, inverse = np.unique(owner * max(1, len(self.terms)) + term, return_inverse=True)
        owner, term = np.divmod(key, max(1, len(self.terms)))
        weight = (1 + np.log(np.bincount(inverse, n, len(key)))) * self.worth[term]
        return owner, term, weight / np.sqrt(np.bincount(owner, weight**2))[owner]

    def votes(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, without: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """The vote of each text, -1 for one without neighbours, and the neighbours."""
        out = []
        for s, near in self.index.top(owner, term, weight, texts, K, without):
            say = 1 / (1.05 - np.minimum(s, 1))
            out.append((float((say * self.labels[near]).sum() / say.sum()) if len(near) else -1.0, near))
        return out

    def score(self, texts: Sequence[str]) -> list[tuple[float, list[int]]]:
        """Probability of label 1 of each text, and the ids of its neighbours."""
        if self.index is None or not self.index.n:
            return [(self.share, [])] * len(texts)
        found = self.votes(*self.vectors(texts), len(texts))
        raw = np.interp([v for v, _ in found], *self.curve).tolist()
        return [(r, self.ids[near].tolist()) if len(near) else (self.share, []) for r, (_, near) in zip(raw, found)]


def surprise(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Likelihood-ratio statistic of a term in a of n1 and b of n0 texts; chance over many terms stays below 2 log(terms)."""
    share = (a + b) / (n1 + n0)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(a, share * n1) + part(n1 - a, (1 - share) * n1) + part(b, share * n0) + part(n0 - b, (1 - share) * n0))


def worth(a: np.ndarray, b: np.ndarray, tells: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """What terms in a of n1 and b of n0 texts weigh; tells: those that set the labels apart."""
    base = min(max(n1 / (n0 + n1), 1e-6), 1 - 1e-6)
    p = (a + SHRINK * base) / (a + b + SHRINK)
    evidence = np.where(tells, np.abs(np.log(p / (1 - p)) - np.log(base / (1 - base))), 0)
    return (np.log((1 + n0 + n1) / (1 + a + b)) + 1) * (FLOOR + evidence)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve through the weighted means of y over x, drawn a little towards the mean of all."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    w = np.ones(len(x)) if weight is None else weight / weight.mean()
    mean, order = float((y * w).sum() / w.sum()), np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, least x, most x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots, values = [], []
    for s, n, low, high in blocks:
        v = (s + mean) / (n + 1)
        for at in {low, high}:
            knots.append(at)
            values.append(v)
    order = np.argsort(knots, kind="stable")
    return np.array(knots)[order], np.maximum.accumulate(np.array(values)[order])


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, toxic and text of the examples, and how many labelled rows each one stands for."""
    of_doc = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    of_doc = of_doc.filter(~held_out())
    sizes = dict(of_doc.groupBy("toxic").count().collect())
    n1 = min(sizes.get(1, 0), max(most // 2, most - sizes.get(0, 0)))
    parts = {c: min(1.0, n / sizes[c]) for c, n in ((1, n1), (0, most - n1)) if sizes.get(c)}
    below = F.when(F.col("toxic") == 1, int((1 << 30) * parts.get(1, 0))).otherwise(int((1 << 30) * parts.get(0, 0)))
    chosen = of_doc.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < below)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    train = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return storage.materialize(train, "toxicity_examples"), {c: 1 / p for c, p in parts.items()}


def _terms(train: DataFrame) -> DataFrame:
    """In how many texts of each label each term is: name, head (null for a word), n0, n1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("name", pa.int64()), ("head", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])
        for batch in batches:
            n: Counter = Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words_of(text)
                n.update((w, y) for w in own)
                n.update((t, y) for t in {t for w in own for t in beginnings(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([number(t) for t, _ in n], pa.int64()), pa.array([t[:HEAD] if t[-1] == "-" else None for t, _ in n], pa.string()), pa.array([c * (y == 0) for (_, y), c in n.items()], pa.int64()), pa.array([c * (y == 1) for (_, y), c in n.items()], pa.int64())],
                schema=shape,
            )

    rows = train.select("toxic", "text").mapInArrow(counted, "name long, head string, n0 long, n1 long")
    return rows.groupBy("name", "head").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from labelled rows that are not held out."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    train, stands_for = _examples(docs, labels, examples)
    counts = storage.materialize(_terms(train), "toxicity_terms")
    sizes = dict(train.groupBy("toxic").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 + n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), frozenset())
    every = sum(stands_for[c] * n for c, n in sizes.items())
    share = stands_for.get(1, 0) * n1 / every
    # every word, and the beginnings that chance over all terms would not give; its size is that of the examples
    tells = surprise(F.col("n1"), F.col("n0"), n1, n0) > 2 * float(np.log(max(2, counts.count())))
    kept = counts.withColumn("tells", tells).filter(F.col("head").isNull() | F.col("tells")).toArrow().combine_chunks().sort_by("name")
    name, a, b, strong = (kept.column(x).to_numpy() for x in ("name", "n1", "n0", "tells"))
    heads = frozenset(x for x in kept.column("head").to_pylist() if x is not None)
    model = Model(name, worth(a, b, strong, n1, n0), heads, share=share)
    sent = spark.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            owner, term, weight = own.vectors(batch.column(2).to_pylist())
            cut = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut, pa.array(term)), pa.ListArray.from_arrays(cut, pa.array(weight))], ["doc_id", "toxic", "terms", "weights"])

    rows = train.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<long>, weights array<double>").toArrow().combine_chunks().sort_by("doc_id")
    _index(model, rows, strong, np.array([stands_for.get(c, 1.0) for c in (0, 1)]))
    return model


def _index(model: Model, rows: pa.Table, strong: np.ndarray, stands_for: np.ndarray) -> None:
    """Give the model its index and curve. rows: the examples' vectors, by doc_id."""
    lists = rows.column("terms").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    term, weight = lists.flatten().to_numpy(), rows.column("weights").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(size)), size)
    often = np.bincount(term, minlength=len(model.terms)) > len(size) / DENSE
    # rows that share their heaviest telling term, then their heaviest frequent one, lie together, so that blocks differ

    def heaviest(mask: np.ndarray) -> np.ndarray:
        out = np.full(len(size), -1)
        order = np.lexsort((weight[mask], owner[mask]))
        out[owner[mask][order]] = term[mask][order]  # the last one of a row stays
        return out

    full = np.flatnonzero(size)
    order = full[np.lexsort((full, heaviest(often[term])[full], heaviest(strong[term])[full]))]
    place = np.full(len(size), -1)
    place[order] = np.arange(len(order))
    labels = rows.column("toxic").to_numpy()[order]
    model.labels, model.ids = labels.astype(float), rows.column("doc_id").to_numpy()[order]
    model.index = BlockMaxIndex(place[owner], term, weight, len(order), len(model.terms), prefer=model.ids)
    by = np.argsort(place[owner], kind="stable")
    found = model.votes(place[owner][by], term[by], weight[by], len(order), np.arange(len(order)))
    raw = np.array([v for v, _ in found])
    some = raw >= 0
    model.curve = isotonic(raw[some], model.labels[some], stands_for[labels[some]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, neighbours (ids of the labelled examples that voted, nearest first)."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = own.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.list_(pa.int64()))], ["doc_id", "score", "neighbours"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, score double, neighbours array<long>")


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns they had."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    sent, at, width = spark.sparkContext.broadcast(model), docs.columns.index("text"), threshold

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([s < width for s, _ in own.score([x or "" for x in batch.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
