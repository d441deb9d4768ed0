import random

import numpy as np
import pyarrow as pa

from leafmill.llm import ngram_join

DOCS = "doc_id long, text string"


def brute_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def made(rng):
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=30))
    texts = []
    for _ in range(25):  # families of copies that drift apart, so that links make chains
        at = rng.choices(words, k=rng.choice((8, 40, 60, 120)))
        for _ in range(rng.choice((1, 2, 5))):
            texts.append(" ".join(at))
            for _ in range(rng.choice((1, 2, 4))):
                at = [*at]
                at[rng.randrange(len(at))] = rng.choice(words)
    texts += [f"{passage} {' '.join(rng.choices(words, k=rng.choice((5, 25, 60))))}" for _ in range(25)]
    head = rng.choices(words, k=60)
    texts += [" ".join([*head, f"t{i}"]) for i in range(12)]  # one prefix and size, different texts
    return texts


def found(docs, **options):
    return sorted((tuple(r) for r in ngram_join.linked_documents(docs, **options).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = made(rng)
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, " \n "), (None, texts[0]), (None, "alone here"), (7, texts[40]), (503, "a b c"), (504, "A B\tC"), (505, "a b c d e"), (506, "long " * 30_000), (rows[0])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n int, node int").repartition(5)
    want = brute(rows)
    assert len({x[2] for x in want}) < len(rows) - 30
    assert found(docs) == want
    # every key range over its bound, and chunks that cut every key
    assert found(docs, most=1, chunk=3, few=1, rounds=1) == want


def test_empty(spark):
    assert found(spark.createDataFrame([], DOCS)) == []


def test_words_are_those_between_white_space():
    h = lambda x: ngram_join.word_hashes(x).tolist()
    assert h("") == h(" \n\t") == [] and h(" Ab\x0bcD\r\n\x00e ") == h("ab") + h("cd") + h("\x00e")
    assert h("É é") == h("É") + h("é") and h("É") != h("é") and h("a\x00") != h("a") and h("a\xa0b") != h("a b")
    long = "x y " * 400_000 + "z" * 3_000_000 + " end"  # pieces, and a word beyond them
    assert len(h(long)) == 800_002 and h(long)[:2] == h("x y") and h(long)[-1:] == h("end")


def test_pairs_that_are_left_out_cannot_be_linked():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        for keep in (50, 47, 44, 40, 35):
            sets.append(np.unique(np.concatenate([base[:keep], rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)])))
    sets = sets[:150]
    n = len(sets)
    sketches = [ngram_join.sketch_of(x) for x in sets[: n - 3]] + [None] * 3  # no sketch, no verdict
    table = pa.table({"gid": range(n), "label": range(n), "root": range(n), "n": [len(x) for x in sets], "own": [0] * n, "i": [0] * n, "j": [0] * n, "kid": [7] * n, "kids": [[9, 7]] * n, "sketch": pa.array(sketches, pa.binary())})
    kept = {(a, b) for a, b in zip(*(ngram_join._compared(table, True)[c].to_pylist() for c in ("gid_a", "gid_b")))}
    linked = {(i, j) for i in range(n) for j in range(i + 1, n) if ngram_join.similar(sets[i], sets[j])}
    assert linked and linked <= kept and len(kept) < n * (n - 1) / 8
    # under another of the keys that all have in common the pairs don't count again
    assert len(ngram_join._compared(table.set_column(table.column_names.index("kid"), "kid", pa.array([9] * n)), True)) == 0
    assert set(ngram_join._compared(table, False)["gid"].to_pylist()) == {x for p in kept for x in p}
