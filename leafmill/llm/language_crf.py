"""Language identification of code-switched text by a linear-chain conditional random field.

Every line is a chain of its words. A word's evidence is the sum of learned weights of its
character n-grams of one to four (with marks at both ends, so those at the marks are affixes)
and of its entry in a lexicon of frequent words; learned transitions tie neighbours. Forward and
backward passes give each word a distribution over languages; a document's is their mean, and it
gets the language with most of it. Neighbouring words of one line that are likeliest in the same
language are a span, so a mixed text's languages come with their places.

Fitting maximises the likelihood of chains spliced from spans of labelled documents, so that
transitions between languages are learned too. It learns every language that a labelled row has, from
an equal share of about DOCUMENTS rows for each (LEAST_DOCUMENTS where there are many languages); of a longer text than CHARS
characters it sees a stretch of that length, from a place that the id's hash says. Every text is
labelled whole. What is broadcast is one table of weights: at most WEIGHTS numbers for n-grams (more only beyond WEIGHTS / 2**12
languages) and LEXICON for each language, so it grows with the languages and not with the rows.

Contract for odd input: a null text or one without a letter is `und` with score 0 and no spans; null langs
are not learned from; equal languages go to the first by name; with no labelled rows every text is
`und`; rows that repeat are labelled alike; an empty table gives an empty result; columns other
than doc_id, text and (for fitting) lang are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .holdout import held_out

DOCUMENTS, LEAST_DOCUMENTS, CHARS = 2_000, 20, 20_000
SLOTS, LEXICON, LEAST, WEIGHTS = 1 << 17, 1 << 14, 4, 1 << 25
STEPS, CHAINS, LENGTH, RATE, SHRINK = 300, 48, 48, 0.3, 1e-6
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"([^\W\d_]+)")
_GRAMS = 4
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def words_of(line: str) -> list[str]:
    return _WORD.findall(line)


def lowered(text: str) -> str:
    """In lower case, each character in its place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def slots_for(languages: int) -> int:
    """Slots of n-grams, a power of two that keeps their weights within WEIGHTS; 2**12 at least."""
    return max(1 << 12, min(SLOTS, 1 << (WEIGHTS // max(1, languages)).bit_length() - 1))


def features(words: Sequence[str], lexicon: dict[str, int], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature slots for each character place of the marked words, and where each word starts."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    stop = np.repeat(start + size, size)
    place = np.arange(len(codes))
    table = np.full((len(codes), _GRAMS), slots + LEXICON, np.int64)  # the last slot weighs nothing
    h = np.zeros(len(codes), np.uint64)
    for n in range(_GRAMS):
        fits = place + n < stop
        h[fits] = (h[fits] ^ codes[place[fits] + n]) * _MIX[n] & np.uint64(0xFFFFFFFFFF)
        table[fits, n] = ((h[fits] ^ (h[fits] >> np.uint64(17))) % np.uint64(slots)).astype(np.int64)
    # the lexicon's entry takes the place of the bare first mark
    table[start, 0] = [slots + lexicon.get(w, LEXICON) for w in words]
    return table, start


#: (start, stop, language, probability) of a stretch of words, in code points.
Span = tuple[int, int, str, float]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    @property
    def slots(self) -> int:
        return len(self.weights) - LEXICON - 1

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """A row of weights over languages for each word."""
        table, start = features(words, self.lexicon, self.slots)
        per_place = self.weights[table[:, 0]]
        for n in range(1, _GRAMS):
            per_place += self.weights[table[:, n]]
        return np.add.reduceat(per_place, start, axis=0)

    def label(self, texts: Sequence[str]) -> list[tuple[str, float, list[Span]]]:
        """The language of each text, its share of the words' distributions, and the spans."""
        k = len(self.languages)
        flat: list[str] = []
        starts, lengths, owner, begins, ends = [], [], [], [], []
        for i, text in enumerate(texts):
            place = 0
            for line in lowered(text).split("\n"):
                parts = _CUT.split(line)  # what is between words, and every other time a word
                found = parts[1::2]
                if found:
                    starts.append(len(flat))
                    lengths.append(len(found))
                    owner.append(i)
                    flat += found
                    edge = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + place
                    begins.append(edge[:-1:2])
                    ends.append(edge[1::2])
                place += len(line) + 1
        if not flat or not k:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        distinct = list(set(flat))
        number = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        # a match of \w that is no letter has no say
        letters = np.fromiter((any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
        e = self.emissions(distinct) * letters[:, None]
        e = np.exp(e - e.max(1, keepdims=True))
        starts = np.array(starts)
        post = posteriors(e[at], np.exp(self.transitions - self.transitions.max()), starts, np.array(lengths))
        says = letters[at]
        mass = np.add.reduceat(post * says[:, None], starts, axis=0)
        total = np.zeros((len(texts), k))
        np.add.at(total, owner, mass)
        n = total.sum(1)
        best = total.argmax(1)
        line = np.repeat(np.arange(len(lengths)), lengths)
        spans = self._spans(post[says], line[says], np.array(owner), np.concatenate(begins)[says], np.concatenate(ends)[says], len(texts))
        return [(self.languages[b], min(1.0, float(total[i, b] / n[i])), spans[i]) if n[i] > 0 else (UNKNOWN, 0.0, []) for i, b in enumerate(best.tolist())]

    def _spans(self, post: np.ndarray, line: np.ndarray, owner: np.ndarray, begins: np.ndarray, ends: np.ndarray, texts: int) -> list[list[Span]]:
        """Runs of words of one line with one likeliest language, by text. owner: the text of each line."""
        out: list[list[Span]] = [[] for _ in range(texts)]
        if not len(post):
            return out
        own = post.argmax(1)
        cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (line[1:] != line[:-1])))
        likely = np.add.reduceat(post.max(1), cut) / np.diff(np.append(cut, len(own)))
        last = np.append(cut[1:], len(own)) - 1
        for i, s, t, y, p in zip(owner[line[cut]].tolist(), begins[cut].tolist(), ends[last].tolist(), own[cut].tolist(), likely.tolist()):
            out[i].append((s, t, self.languages[y], min(1.0, p)))
        return out

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        return [(x, p) for x, p, _ in self.label(texts)]


def posteriors(e: np.ndarray, t: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward and backward over many chains at once, longest first. e: evidence by word, t: by pair."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")  # chains longer than each step
    alpha = np.empty_like(e)
    last = None
    for step, n in enumerate(live.tolist()):
        at = starts[:n] + step
        a = e[at] if last is None else (last[:n] @ t) * e[at]
        last = a / a.sum(1, keepdims=True)
        alpha[at] = last
    beta = np.ones((len(starts), e.shape[1]))
    for step in range(len(live) - 2, -1, -1):
        n = int(live[step + 1])
        at = starts[:n] + step
        b = (e[at + 1] * beta[:n]) @ t.T
        beta[:n] = b / b.sum(1, keepdims=True)
        alpha[at] *= beta[:n]
    return alpha / alpha.sum(1, keepdims=True)


def fit_chains(docs: list[tuple[str, str]], seed: int = 7) -> Model:
    """docs: (text, language)."""
    languages = sorted({x for _, x in docs})
    k, slots = len(languages), slots_for(len({x for _, x in docs}))
    known = {x: i for i, x in enumerate(languages)}
    bodies = [(words_of(lowered(t)), known[x]) for t, x in docs if x in known]
    bodies = [b for b in bodies if b[0]]
    count = Counter(w for ws, _ in bodies for w in ws)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= LEAST}
    model = Model(languages, np.zeros((slots + LEXICON + 1, k), np.float32), np.zeros((k, k)), lexicon)
    if k < 2 or not bodies:
        return model
    rng = np.random.default_rng(seed)
    by_language = [[ws for ws, y in bodies if y == i] for i in range(k)]
    by_language = [x for x in by_language if x]
    names = [i for i in range(k) if any(y == i for _, y in bodies)]
    square, square_t = np.full_like(model.weights, 1e-3), np.full((k, k), 1e-3)
    for _ in range(STEPS):
        flat: list[str] = []
        gold: list[int] = []
        for _ in range(CHAINS):  # a chain is spans of documents, of any languages
            left = LENGTH
            while left > 0:
                j = int(rng.integers(len(names)))
                ws = by_language[j][int(rng.integers(len(by_language[j])))]
                n = min(left, int(rng.integers(3, 30)), len(ws))
                a = int(rng.integers(len(ws) - n + 1))
                flat += ws[a : a + n]
                gold += [names[j]] * n
                left -= n
        distinct = sorted(set(flat))
        number = {w: i for i, w in enumerate(distinct)}
        at, y = np.array([number[w] for w in flat]), np.array(gold).reshape(CHAINS, LENGTH)
        table, start = features(distinct, lexicon, slots)
        e = np.add.reduceat(model.weights[table].sum(1), start, axis=0)[at].reshape(CHAINS, LENGTH, k).astype(float)
        e = np.exp(e - e.max(2, keepdims=True))
        t = np.exp(model.transitions - model.transitions.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for s in range(LENGTH):
            a = e[:, s] if s == 0 else (alpha[:, s - 1] @ t) * e[:, s]
            alpha[:, s] = a / a.sum(1, keepdims=True)
        for s in range(LENGTH - 2, -1, -1):
            b = (e[:, s + 1] * beta[:, s + 1]) @ t.T
            beta[:, s] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        # each pair's distribution over two languages, summed over all pairs
        after = (e[:, 1:] * beta[:, 1:]).reshape(-1, k)
        before = alpha[:, :-1].reshape(-1, k)
        pairs = t * (before / ((before @ t) * after).sum(1, keepdims=True)).T.dot(after)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        step_t = (seen - pairs) / CHAINS
        square_t += step_t**2
        model.transitions += RATE * step_t / np.sqrt(square_t)
        miss = np.eye(k)[y.ravel()] - post.reshape(-1, k)
        per_word = np.zeros((len(distinct), k))
        np.add.at(per_word, at, miss / CHAINS)
        sizes = np.diff(np.append(start, len(table)))
        rows, inverse = np.unique(table, return_inverse=True)
        grad = np.stack([np.bincount(inverse.ravel(), np.repeat(np.repeat(per_word[:, c], sizes), _GRAMS), len(rows)) for c in range(k)], axis=1)
        grad -= SHRINK * model.weights[rows]
        square[rows] += grad**2
        model.weights[rows] += RATE * grad / np.sqrt(square[rows])
        model.weights[-1] = 0
    return model


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> Model:
    """Learn from labelled rows that are not held out. Each language gives about an equal share of
    `documents` rows, and LEAST_DOCUMENTS where there are many languages."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return fit_chains([])
    per = max(LEAST_DOCUMENTS, documents // len(sizes))
    share = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, per / r["count"]))) for r in sizes], "lang string, below long")
    chosen = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < F.col("below")).dropDuplicates(["doc_id", "text", "lang"])
    spare = F.greatest(F.char_length("text") - CHARS, F.lit(0))
    stretch = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit("stretch")), spare + 1) + 1).cast("int"), F.lit(CHARS))
    return fit_chains(sorted((r.text, r.lang) for r in chosen.select(stretch.alias("text"), "lang").collect()))


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, stop, lang, probability)."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = own.label(batch.column(1).to_pylist())
            flat = [x for _, _, spans in found for x in spans]
            at = np.cumsum([0] + [len(spans) for _, _, spans in found])
            parts = pa.StructArray.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*flat) if flat else ((),) * 4, span.value_type)], fields=list(span.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts)], ["doc_id", "lang_pred", "score", "spans"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string,probability:double>>")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    return label(docs, model).select("doc_id", "lang_pred", "score")
