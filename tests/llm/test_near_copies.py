import random

import pandas as pd

import corpus_pipeline
from leafmill.llm import near_copies

DOCS = "doc_id long, text string, kind int"


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if brute_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    best = {}
    for i, r in enumerate(root):
        best[r] = min(best.get(r, rows[i][0]), rows[i][0])
    return set(best.values())


def planted():
    """Copies of 30 texts with 1 to 12 words changed: similarities from 0.3 to 1."""
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randrange(60, 400))
        for changes in (0, 1, 2, 3, 4, 6, 9, 12):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(i, t, 1) for i, t in enumerate(texts)]


def test_near_copies_do_not_survive_the_stage(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_kept(rows)
    assert 30 < len(want) < 240
    got = corpus_pipeline.dedup_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_small_chunks_find_the_same(spark):
    docs = spark.createDataFrame(planted()[:120], DOCS)
    first = near_copies._first(docs, 5)
    found = []
    for limits in ({}, {"chunk": 2}, {"chunk_shingles": 300}):
        roots = near_copies.simhash.components(near_copies.links(docs, first, **limits)).collect()
        found.append(sorted((r.node, r.root) for r in roots))
    assert found[0] and found[0] == found[1] == found[2]


def test_similarity_is_exact():
    def group(a, b):
        sets = [near_copies.shingle_set(near_copies.hashes_of(x)).tobytes() for x in (a, b)]
        return pd.DataFrame({"node": ["a", "b"], "own": [0, 0], "i": [0, 0], "j": [0, 0], "hashes": sets})

    words = [f"w{i}" for i in range(13)]  # 9 shingles; of 8 of them, 8 / 9; without the first two, 7 / 9
    assert near_copies._forest(group(" ".join(words), " ".join(words[1:])), 0.8) == [("a", "b")]
    assert near_copies._forest(group(" ".join(words), " ".join(words[2:])), 0.8) == []
    assert near_copies._forest(group(" ".join(words[:9]), " ".join(words[:8])), 0.8) == [("a", "b")]  # 4 / 5


def test_odd_rows(spark):
    a, b = "a b c d e f", "x y z u v w t"
    rows = [(8, a, 1), (8, b, 2), (8, b, 2), (9, a, 3), (None, a, 4), (None, "n m o p q", 5), (4, None, 6), (3, "", 7), (5, " \n", 8), (11, "One two", 9), (10, "one  TWO", 10)]
    docs = spark.createDataFrame([(*r, r[2], "x", r[0], 3) for r in rows], DOCS + ", node int, row string, id long, __node int")
    assert sorted(r.kind for r in near_copies.keep_first(docs).collect()) == [1, 2, 5, 7, 10]
    assert near_copies.keep_first(docs).columns == docs.columns
    assert all(r.node == r.kind and r.id == r.doc_id and (r.row, r["__node"]) == ("x", 3) for r in near_copies.keep_first(docs).collect())
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_texts_of_near_fingerprints_meet_without_bands(spark):
    """Op2's variants alone bring together what differs in at most three bits."""
    rng, rows = random.Random(3), []
    for _ in range(12):
        base = [f"word{rng.randrange(500)}" for _ in range(900)]
        for _ in range(4):
            rows.append((len(rows), " ".join(base), 1))
            base[rng.randrange(900)] = "other"
    docs = spark.createDataFrame(rows, DOCS)
    first = near_copies._first(docs, 5)
    linked = {frozenset(x) for x in near_copies.simhash.links(first.select("fp").distinct()).collect()}
    some = first.withColumn("bands", near_copies.F.array().cast("array<long>"))
    found = {r.node: r.root for r in near_copies.simhash.components(near_copies.links(docs, some)).collect()}
    fp = {r.node: (r.fp, r.own.id) for r in first.collect()}
    text = {i: t for i, t, _ in rows}
    near = [(a, b) for a in fp for b in fp if a < b and bin((fp[a][0] ^ fp[b][0]) & (2**64 - 1)).count("1") <= 3]
    assert len(near) > 20 and linked
    for a, b in near:
        if brute_jaccard(brute_shingles(text[fp[a][1]]), brute_shingles(text[fp[b][1]])) >= 0.8:
            assert found[a] == found[b]
