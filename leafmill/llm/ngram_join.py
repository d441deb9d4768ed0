"""Grouped prefix join of texts by the Jaccard similarity of their word n-grams, exact in what it links.

A text is the set of its different shingles, each a 64-bit hash. All sets are sorted in one global order; if two are similar enough, the first
n - ceil(s * n) + 1 shingles of each, their prefixes, have one in common. Sets with the same prefix and size are one group, and only groups are joined:

1. Order: counters over all texts, SLOTS of them whatever the corpus, tell often seen shingles from rare ones. Rare ones come first, so a passage that many
   documents share is no prefix of any of them. Counters that many shingles share make prefixes less telling, never wrong.
2. Index: the prefixes of all groups, packed by key range and shuffled once; a key that one group alone has goes away there. A range that holds more than
   RANGE_MOST entries (a key of very many groups) is counted and joined as plain rows instead, which Spark can split.
3. Stars: every group is compared with one group that it shares most keys with, and every member of a group with the group's first.
4. What may yet be linked: only keys whose groups are still in different components are looked at again. Under keys of at most FEW groups, pairs are counted, and
   by the keys in common and the sizes a pair is kept or can't be similar enough. The groups of a key of more are cut into chunks, every pair of chunks is a task's group
   of bounded size, and only who has a possible partner leaves it, not the pairs. Sketches (bitmaps of the sets, which bound what two can have in common) sort out the most.
5. Stars about other centres, and each component's best pair, round by round, join what is one family of copies with as many comparisons a round as there are texts.
6. The pairs that are left are verified by their whole sets, every member of a group's part against every member.

Contract for odd input: a null text, an empty one or one without a word has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; rows that repeat, and rows of one doc_id with different texts, each get a row and are linked by their texts alone; a row without a doc_id links others but names no component, and its own
is null where it is alone; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, storage

WORDS, SEED = 5, 42
#: The similarity that links, as a fraction.
LEAST, OF = 80, 100
#: Counters of the order, and how many rows carry them.
SLOTS, PARTS = 1 << 20, 16
#: Index entries of a key range, in expectation, and what one task takes of it at most.
RANGE, RANGE_MOST = 1 << 20, 1 << 23
#: A key of more groups than FEW has its groups cut into chunks of CHUNK, in expectation; the others are RANGE_OPEN entries a task.
FEW, CHUNK, RANGE_OPEN = 64, 4096, 1 << 18
#: Bits of the map of wanted texts: 2 to this.
BITS = 23
#: Rounds of stars among what is still apart, at most.
ROUNDS = 5

_DRAWN = np.random.default_rng(SEED)
_BY_PLACE = _DRAWN.integers(0, 1 << 64, WORDS * 8, np.uint64) | np.uint64(1)
_BY_LENGTH = _DRAWN.integers(0, 1 << 64, WORDS * 8 + 1, np.uint64)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


_LOWER = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a text that are hashed at once, and the powers of an odd number up to there, and of its inverse.
PIECE = 1 << 20
_BASE = 0x9FB21C651E98DF25
_POWERS = np.cumprod(np.full(2 * PIECE, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(2 * PIECE, pow(_BASE, -1, 1 << 64), np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end where words do."""
    at = 0
    while len(raw) - at > PIECE:
        end = raw.rfind(b" ", at + 1, at + PIECE)
        if end < 0:
            end = raw.find(b" ", at + PIECE)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, by polynomials over its bytes. Words are cut at the bytes 0x20 and 0x09 to 0x0D, and A-Z are lowered."""
    found = []
    for piece in _pieces(text.encode().translate(_LOWER)):
        if len(piece) > 2 * PIECE:  # one word
            found.append(np.array([xxhash.xxh64_intdigest(piece.strip(b" "), SEED)], np.uint64))
            continue
        letters = np.frombuffer(piece, np.uint8)
        edges = np.flatnonzero(np.diff((letters == 32).view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * _POWERS[: len(letters)], out=sums[1:])
        found.append(_mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64) * _MIX))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as hashes, rising."""
    word = word_hashes(text)
    if not len(word):
        return word
    width = min(words, len(word))
    n = len(word) - width + 1
    h = np.full(n, _BY_LENGTH[width], np.uint64)
    for i in range(width):
        h += word[i : i + n] * _BY_PLACE[i]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def frequencies(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How often shingles of each slot are seen, one small number a slot: rounded logarithms of the texts that have them."""
    each = SLOTS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            found = [shingles(x, words) for x in batch.column(0).to_pylist()]
            if found:
                seen += np.bincount(_slots(np.concatenate(found)), minlength=SLOTS)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in seen.reshape(PARTS, each)], pa.binary())], ["part", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole[part] = whole.get(part, 0) + np.frombuffer(seen, "<u4").astype(np.int64)
        for part, seen in whole.items():
            level = np.minimum(255, np.round(4 * np.log2(seen + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, "part int, seen binary").repartition(PARTS, "part").mapInArrow(add, "part int, level binary")
    out = np.zeros((PARTS, each), np.uint8)
    for r in counted.collect():  # PARTS rows, SLOTS bytes in all
        out[r.part] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def sketch_of(hashes: np.ndarray) -> bytes:
    """A bitmap of a set, of four bits a shingle at least; a larger one folds to a smaller one by halves."""
    width = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def _possible(n_a, a: np.ndarray, n_b, b: np.ndarray):
    """Whether sets of these sizes and sketches may be linked: every bit that one has alone is a shingle that the other lacks."""
    to = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, to), _folded(b, to)
    both = np.minimum(n_a - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))
    return both * (OF + LEAST) >= (n_a + n_b) * LEAST


def prefix_size(n: int) -> int:
    return n - -(-n * LEAST // OF) + 1


def _prefixes(docs: DataFrame, levels: np.ndarray, words: int) -> DataFrame:
    """A row per document: doc_id, n (shingles), node (its set by a digest, null if empty), same (prefix and size by a digest), prefix, sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # SLOTS bytes

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, same, prefixes, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                n = len(found)
                sizes.append(n)
                first = found[np.lexsort((found, sent.value[_slots(found)]))[: prefix_size(n)]].tobytes() if n else None
                sketches.append(sketch_of(found) if n else None)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                same.append(xxhash.xxh3_128_digest(n.to_bytes(8, "little") + first) if n else None)
                prefixes.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (nodes, same, prefixes, sketches))], ["doc_id", "n", "node", "same", "prefix", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n long, node binary, same binary, prefix binary, sketch binary")


def _shared(groups: DataFrame, most: int) -> DataFrame:
    """(key, gid, hub) for every prefix shingle that two groups have or more; hub is the smallest of them."""
    entries = groups.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, entries / RANGE)))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0

        def packed() -> pa.RecordBatch:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key)
            key, owner = key[order], owner[order]
            at = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            found, start = np.unique(at, return_index=True)
            ends = [*start[1:].tolist(), len(key)]
            cuts = list(zip(start.tolist(), ends))
            return pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array([b - a for a, b in cuts], pa.int64()), pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in cuts], pa.binary())],
                ["range", "n", "keys", "owners"],
            )

        for batch in batches:
            for gid, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(np.frombuffer(prefix, np.uint64))
                owners.append(np.full(len(keys[-1]), gid, np.int64))
                held += len(keys[-1])
                if held >= RANGE:
                    yield packed()
                    keys, owners, held = [], [], 0
        if held:
            yield packed()

    packed = storage.materialize(groups.select("gid", "prefix").mapInArrow(pack, "range long, n long, keys binary, owners binary"), "ngram_index")
    sizes = packed.groupBy("range").agg(F.sum("n").alias("whole"))
    sized = packed.join(sizes, "range")

    def together(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()])
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        _, start, index, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        more = count[index] > 1
        return pa.table([pa.array(key[more].view(np.int64)), pa.array(owner[more]), pa.array(owner[start[index]][more])], ["key", "gid", "hub"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, owners in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(owners, np.int64))], ["key", "gid"])

    near = sized.filter(F.col("whole") <= most).select("range", "keys", "owners").groupBy("range").applyInArrow(together, "key long, gid long, hub long")
    rows = sized.filter(F.col("whole") > most).select("keys", "owners").mapInArrow(apart, "key long, gid long")
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("gid").alias("hub")).filter("n > 1").select("key", "hub")
    out = storage.materialize(near.unionByName(rows.join(many, "key").select("key", "gid", "hub")), "ngram_shared")
    storage.drop(packed)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of different hashes are linked."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * LEAST:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * LEAST


def _verified(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """The pairs (a, b) that are linked, with the columns of more. sets: (nid, hashes)."""
    kept = ["a", "b", *more]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (np.frombuffer(x, np.uint64) for x in batch.column("of").to_pylist())
            to = (np.frombuffer(x, np.uint64) for x in batch.column("to").to_pylist())
            yield batch.select(kept).filter(pa.array([similar(x, y) for x, y in zip(of, to)], pa.bool_()))

    left = sets.select(F.col("nid").alias("a"), F.col("hashes").alias("of"))
    right = sets.select(F.col("nid").alias("b"), F.col("hashes").alias("to"))
    return pairs.select(*kept).join(left, "a").join(right, "b").select(*kept, "of", "to").mapInArrow(linked, ", ".join(f"{c} long" for c in kept))


def _bit(ids: pa.Array) -> np.ndarray:
    return ((ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _bits_of(ids: DataFrame) -> np.ndarray:
    """A bitmap in which the bits of all of one column's ids are set: 2**BITS bits whatever the ids are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            seen[_bit(batch.column(0))] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.packbits(seen).reshape(PARTS, -1)], pa.binary())], ["part", "seen"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole[part] = np.frombuffer(seen, np.uint8) | whole.get(part, np.uint8(0))
        for part, seen in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen.tobytes()], pa.binary())], ["part", "seen"])

    out = np.zeros((PARTS, (1 << BITS) // 8 // PARTS), np.uint8)
    for r in ids.mapInArrow(mark, "part int, seen binary").repartition(PARTS, "part").mapInArrow(unite, "part int, seen binary").collect():  # PARTS rows
        out[r.part] = np.frombuffer(r.seen, np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(nid, hashes) for each of wanted (nid, node, own). Texts stay where they are: a bitmap of the wanted ids says which to hash, and what it says too much is dropped after."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits_of(wanted.select("own")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(sent.value[_bit(batch.column(0))]))
            found = [shingles(x, words).tobytes() for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(of, "node binary, hashes binary").dropDuplicates(["node"]).join(wanted.select("nid", "node"), "node")
    return storage.materialize(found.select("nid", "hashes"), "ngram_sets")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, gid, label): the component of every node, by its smallest nid."""
    roots = simhash.components(links, "ngram").withColumnRenamed("node", "nid")
    return storage.materialize(nodes.select("nid", "gid").join(roots, "nid", "left").select("nid", "gid", F.coalesce("root", "nid").alias("label")), "ngram_labels")


def _compared(table: pa.Table, pairs: bool) -> pa.Table:
    """Of one key's two chunks, the pairs of different components that may be linked by their sizes and sketches, each under the first of the keys that its ends have in
    common; or only who is in such a pair, and in how many. What has no sketch (several texts) may be linked with all of its size."""
    gid, label, root, n, own = (table[c].to_numpy() for c in ("gid", "label", "root", "n", "own"))
    words = [None if x is None else np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()]
    widths = np.array([0 if x is None else len(x) for x in words])
    classes = {w: (np.flatnonzero(widths == w), np.stack([words[i] for i in np.flatnonzero(widths == w)])) for w in np.unique(widths[widths > 0]).tolist()}
    folds: dict[tuple[int, int], np.ndarray] = {}
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    right = own == j
    some, seen = [], np.zeros(len(gid), np.int64)
    if pairs:
        kid, kids = table["kid"][0].as_py(), table["kids"].combine_chunks()
        keys = [np.sort(x) for x in np.split(kids.flatten().to_numpy(), np.cumsum(kids.value_lengths().to_numpy())[:-1])]
    for x in np.flatnonzero(own == i).tolist():
        fits = right & (root != root[x]) & (np.minimum(n, n[x]) * OF >= np.maximum(n, n[x]) * LEAST)
        if i == j:
            fits[: x + 1] = False
        if not fits.any():
            continue
        if words[x] is not None:
            for w, (at, stack) in classes.items():
                to = min(w, widths[x])
                if (w, to) not in folds:
                    folds[w, to] = _folded(stack, to)
                fits[at] &= _possible(n[x], words[x], n[at], folds[w, to])
        found = np.flatnonzero(fits)
        if len(found):
            seen[x] += len(found)
            seen[found] += 1
            if pairs:
                once = [y for y in found.tolist() if np.intersect1d(keys[x], keys[y], assume_unique=True)[0] == kid]
                some += [min(((gid[x], label[x]), (gid[y], label[y])), ((gid[y], label[y]), (gid[x], label[x]))) for y in once]
    if not pairs:
        return pa.table([pa.array(x[seen > 0]) for x in (gid, label, seen)], ["gid", "label", "met"])
    made = np.array(some, np.int64).reshape(-1, 4)
    return pa.table([pa.array(made[:, c]) for c in range(4)], ["gid_a", "label_a", "gid_b", "label_b"])


def _in_chunks(entries: DataFrame, parts: DataFrame, chunk: int, pairs: bool) -> DataFrame:
    """entries (kind, key, gid, label, root, n) for every pair of chunks of their key, with i, j, own and the parts' sketches; for pairs with all keys of each part, too."""
    sizes = entries.groupBy("kind", "key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    cut = entries.join(sizes.select("kind", "key", F.ceil(F.col("m") / chunk).cast("int").alias("chunks")), ["kind", "key"])
    cut = cut.withColumn("own", F.pmod(F.xxhash64("gid", "label"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    kid = F.xxhash64("kind", "key")
    cut = cut.select("kind", "key", kid.alias("kid"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "gid", "label", "root", "n")
    cut = cut.join(parts.select("gid", "label", "sketch"), ["gid", "label"])
    if pairs:
        cut = cut.join(entries.groupBy("gid", "label").agg(F.collect_set(kid).alias("kids")), ["gid", "label"])  # no more than its prefix has
    return cut.groupBy("kind", "key", "i", "j")


def _counted(table: pa.Table) -> pa.Table:
    """Pairs of different components that meet under some keys of few groups each, and under how many."""
    kind, key, gid, label, n = (table[c].to_numpy() for c in ("kind", "key", "gid", "label", "n"))
    order = np.lexsort((label, gid, key, kind))
    kind, key, gid, label, n = kind[order], key[order], gid[order], label[order], n[order]
    # a part of a group by one number, rising with gid and label
    by = np.lexsort((label, gid))
    new = np.concatenate([[True], (np.diff(gid[by]) != 0) | (np.diff(label[by]) != 0)])
    code = np.empty(len(gid), np.int64)
    code[by] = np.cumsum(new) - 1
    part = by[new]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(kind) != 0)]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    pairs = [np.zeros(0, np.int64)]
    for m in np.unique(sizes[sizes > 1]).tolist():
        first, second = np.triu_indices(m, 1)
        at = starts[sizes == m][:, None]
        x, y = (at + first).ravel(), (at + second).ravel()
        fits = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * OF >= np.maximum(n[x], n[y]) * LEAST) & ((gid[x] != gid[y]) | (kind[x] == 1))
        pairs.append(code[x[fits]] * len(part) + code[y[fits]])
    pair, count = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = part[pair // len(part)], part[pair % len(part)]
    return pa.table([pa.array(x) for x in (gid[a], label[a], n[a], gid[b], label[b], n[b], count)], ["gid_a", "label_a", "n_a", "gid_b", "label_b", "n_b", "c"])


def _open(shared: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, key, gid, label, n, m) for the keys whose groups are in different components, m entries each. A part of a group is its members of one
    component; a group of several parts is a key (of kind 1) of its own."""
    parts = labels.select("gid", "label").distinct()
    own = parts.groupBy("gid").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select(F.lit(1).alias("kind"), F.col("gid").alias("key"), "gid")
    met = shared.select(F.lit(0).alias("kind"), "key", "gid").unionByName(own).join(parts, "gid")
    keys = met.groupBy("kind", "key").agg(F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("kind", "key", "m")
    sizes = nodes.groupBy("gid").agg(F.first("n").alias("n"))
    return storage.materialize(met.join(keys, ["kind", "key"]).join(sizes, "gid"), "ngram_open")


def _near(left: DataFrame, large: DataFrame) -> DataFrame:
    """(gid_a, label_a, n_a, gid_b, label_b, n_b, c): parts that meet under keys of few groups, and by the keys in common may be similar enough."""
    ranges = 1 + left.count() // RANGE_OPEN
    shape = "gid_a long, label_a long, n_a long, gid_b long, label_b long, n_b long, c long"
    counted = left.groupBy(F.pmod(F.xxhash64("kind", "key"), F.lit(ranges)).alias("range")).applyInArrow(_counted, shape)
    counted = counted.groupBy("gid_a", "label_a", "n_a", "gid_b", "label_b", "n_b").agg(F.sum("c").alias("c"))
    # keys of many groups may be common to a pair, too
    many = large.groupBy("gid", "label").agg(F.count("*").alias("more"))
    for end in "ab":
        counted = counted.join(many.select(F.col("gid").alias(f"gid_{end}"), F.col("label").alias(f"label_{end}"), F.col("more").alias(f"more_{end}")), [f"gid_{end}", f"label_{end}"], "left")
    both = F.col("c") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    rest = lambda n: F.ceil(F.col(n) * LEAST / OF) - 1
    most = F.least(both + F.greatest(rest("n_a"), rest("n_b")), F.col("n_a"), F.col("n_b"))
    return counted.filter((F.col("gid_a") == F.col("gid_b")) | (most * (OF + LEAST) >= (F.col("n_a") + F.col("n_b")) * LEAST)).select("gid_a", "label_a", "gid_b", "label_b", "c")


def _ends(pairs: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """pairs (gid_a, label_a, gid_b, label_b, ...) with columns of rows (gid, label, ...) for both ends."""
    for end in "ab":
        pairs = pairs.join(rows.select(*[F.col(c).alias(f"{c}_{end}") for c in ("gid", "label", *more)]), [f"gid_{end}", f"label_{end}"])
    return pairs


def _sketched(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, ..., n_a, sketch_a, n_b, sketch_b), those that may be linked by their sketches. A null sketch says nothing."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for n_a, a, n_b, b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b"))):
                held.append(a is None or b is None or bool(_possible(n_a, np.frombuffer(a, np.uint64), n_b, np.frombuffer(b, np.uint64))))
            yield batch.filter(pa.array(held, pa.bool_()))

    return pairs.mapInArrow(fit, pairs.schema).drop("n_a", "sketch_a", "n_b", "sketch_b")


def linked_documents(docs: DataFrame, words: int = WORDS, chunk: int = CHUNK, few: int = FEW, most: int = RANGE_MOST, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included)."""
    storage.bounded_batches(docs.sparkSession)
    found = storage.materialize(_prefixes(docs, frequencies(docs, words), words), "ngram_prefixes")
    groups = storage.materialize(found.filter("n > 0").groupBy("same").agg(F.first("prefix").alias("prefix")).withColumn("gid", F.monotonically_increasing_id()), "ngram_groups")
    nodes = found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("own"), F.first("same").alias("same"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = storage.materialize(nodes.join(groups.select("same", "gid"), "same").select(F.monotonically_increasing_id().alias("nid"), "node", "own", "gid", "n", "sketch"), "ngram_nodes")
    rows = storage.materialize(found.select("doc_id", "n", "node"), "ngram_documents")
    storage.drop(found)
    shared = _shared(groups, most)
    storage.drop(groups)

    # each group and the one it has most in common with; each member and its group's first
    firsts = nodes.groupBy("gid").agg(F.min("nid").alias("nid"), F.count("*").alias("members"))
    first = firsts.join(nodes.select("nid", "n", "sketch"), "nid")
    nearest = shared.filter("gid <> hub").groupBy("gid", "hub").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
    of = first.select("gid", F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    to = first.select(F.col("gid").alias("hub"), F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    stars = _sketched(nearest.join(of, "gid").join(to, "hub").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b"))
    inside = nodes.join(firsts.filter("members > 1").select("gid", F.col("nid").alias("b")), "gid").filter("nid <> b").select(F.col("nid").alias("a"), "b")
    tried = storage.materialize(stars.unionByName(inside), "ngram_tried")
    named = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    sets = _sets(docs, nodes.join(named(tried), "nid", "left_semi").select("nid", "node", "own"), words)
    labels = _labelled(nodes, storage.materialize(_verified(tried, sets), "ngram_links"))

    # what is still apart, and may yet be linked
    parts = labels.join(nodes.select("nid", "n", "sketch"), "nid").groupBy("gid", "label").agg(F.min("nid").alias("nid"), F.first("n").alias("n"), F.when(F.count("*") == 1, F.first("sketch")).alias("sketch"))
    parts = storage.materialize(parts, "ngram_parts")
    left = _open(shared, nodes, labels)
    storage.drop(shared)
    large = left.filter(F.col("m") > few).withColumn("root", F.col("label"))
    near = _ends(_near(left.filter(F.col("m") <= few), large), parts, "nid", "n", "sketch").withColumnsRenamed({"nid_a": "a", "nid_b": "b"})
    near = storage.materialize(_sketched(near), "ngram_near")
    alive = _in_chunks(large, parts, chunk, False).applyInArrow(lambda t: _compared(t, False), "gid long, label long, met long").groupBy("gid", "label").agg(F.sum("met").alias("met"))
    alive = storage.materialize(alive, "ngram_alive")
    many = storage.materialize(large.join(alive, ["gid", "label"]).join(parts.select("gid", "label", "nid"), ["gid", "label"]).select("kind", "key", "gid", "label", "n", "nid", "met"), "ngram_many")
    wanted = alive.select("gid", "label").union(near.select("gid_a", "label_a")).union(near.select("gid_b", "label_b")).distinct()
    missing = nodes.join(labels.join(wanted, ["gid", "label"], "left_semi").select("nid"), "nid", "left_semi").join(sets.select("nid"), "nid", "left_anti")
    sets = sets.unionByName(_sets(docs, missing.select("nid", "node", "own"), words))

    # stars again, as long as they join components: first about what has most possible partners, then about others, likelier the more they have
    links = labels.select(F.col("label").alias("a"), F.col("label").alias("b")).limit(0)
    roots = None

    def rooted(rows: DataFrame, label: str, root: str) -> DataFrame:
        if roots is None:
            return rows.withColumn(root, F.col(label))
        return rows.join(roots.select(F.col("node").alias(label), F.col("root").alias("found")), label, "left").withColumn(root, F.coalesce("found", label)).drop("found")

    for r in range(rounds):
        held = rooted(many, "label", "root")
        drawn = F.log((F.pmod(F.xxhash64("gid", "label", F.lit(r)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30) + 1)) / F.col("met") if r else F.col("met").cast("double")
        centre = held.groupBy("kind", "key").agg(F.max_by(F.struct("gid", "label", "root", "n", "nid"), F.struct(drawn, "gid", "label")).alias("hub"))
        about = held.join(centre, ["kind", "key"]).filter((F.col("root") != F.col("hub.root")) & (F.least("n", "hub.n") * OF >= F.greatest("n", "hub.n") * LEAST))
        about = about.groupBy("label", "nid", F.col("hub.nid").alias("b"), F.col("hub.label").alias("label_b")).agg(F.count("*").alias("c")).groupBy("label", "nid").agg(F.max_by(F.struct("b", "label_b"), F.struct("c", "b")).alias("to"))
        pairs = about.select(F.col("nid").alias("a"), "to.b", F.col("label").alias("label_a"), "to.label_b")
        apart = rooted(rooted(near, "label_a", "root_a"), "label_b", "root_b").filter("root_a <> root_b")
        best = apart.groupBy("root_a").agg(F.max_by(F.struct("a", "b", "label_a", "label_b"), F.struct("c", "a", "b")).alias("p")).select("p.*")
        linked = storage.materialize(_verified(pairs.unionByName(best), sets, "label_a", "label_b"), "ngram_links")
        if not linked.take(1):
            break
        links = links.unionByName(linked.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
        roots = simhash.components(links, "ngram_roots")

    # and all pairs that are left, every member against every member
    rest = rooted(rooted(near, "label_a", "root_a"), "label_b", "root_b").filter("root_a <> root_b").select("gid_a", "label_a", "gid_b", "label_b")
    shape = "gid_a long, label_a long, gid_b long, label_b long"
    far = _in_chunks(rooted(many, "label", "root").select("kind", "key", "gid", "label", "root", "n"), parts, chunk, True).applyInArrow(lambda t: _compared(t, True), shape)
    pairs = _ends(storage.materialize(rest.union(far).distinct(), "ngram_rest"), labels, "nid").withColumnsRenamed({"nid_a": "a", "nid_b": "b"})
    last = storage.materialize(_verified(pairs, sets, "label_a", "label_b"), "ngram_links")
    links = links.unionByName(last.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())

    roots = simhash.components(links, "ngram_all")
    named_by = rooted(labels.select("nid", "label"), "label", "root").join(nodes.select("nid", "node", "own"), "nid")
    least = named_by.groupBy("root").agg(F.min("own").alias("component_id"))
    of_node = named_by.join(least, "root").select("node", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
