import random

import xxhash

from leafmill.llm import simhash

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))
    for _ in fps:
        before = list(root)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    return root


def test_fingerprint():
    for text in ("", "  \n", "One", "one two", "A b\x0bc  d", "Straße ÄÖ  x y z", "a a a a a a"):
        assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_segments_are_few():
    assert simhash.segments(3) == [(0, 32), (32, 32)]
    assert len(simhash.segments(5)) == 3


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(8):
            fps.append(at)
            for _ in range(rng.choice((1, 2, 3, 4, 5))):
                at ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps + [0, 7, 2**64 - 1]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (3, 2048):  # a small chunk cuts every bucket
        pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(rows, chunk=chunk).collect()]
        assert all(bin(a ^ b).count("1") <= 3 and a != b for a, b in pairs)
        roots = {r.node: r.root for r in simhash.components(simhash.links(rows, chunk=chunk)).collect()}
        want = brute_components(fps)
        groups, found = {}, {}
        for i, r in enumerate(want):
            groups.setdefault(r, set()).add(fps[i])
        for x, s in zip(fps, signed):
            found.setdefault(roots.get(s, s), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_long_chain(spark):
    at, chain = 0, [0]
    for b in range(60):
        at ^= 1 << b
        chain.append(at)
    rows = spark.createDataFrame([(x,) for x in chain], "fp long")
    assert {r.root for r in simhash.components(simhash.links(rows)).collect()} == {0}


def test_odd_documents(spark):
    rows = [(5, None), (6, ""), (3, "   "), (7, "a b c d"), (8, "A B C D"), (8, "a b c d"), (None, "a b c d"), (9, "word " * 30_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], DOCS + ", fp int")
    got = sorted(((r.doc_id or -1), r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [(d, c) for d, _, c in got] == [(-1, 7), (3, 3), (5, 3), (6, 3), (7, 7), (8, 7), (8, 7), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f", "x y z u v w t"
    rows = [(8, a, 1), (8, b, 2), (8, b, 2), (9, a, 3), (None, a, 4), (None, "n m o p q", 5), (4, None, 6), (3, "", 7)]
    # columns by the names that the operator itself might use come through as they are
    names = ("__fp", "__t", "__id", "__f", "__h", "id", "node", "row", "fp", "root", "own", "wanted_id")
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], DOCS + ", n int" + "".join(f", {x} int" for x in names))
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r[2] for r in got.collect()) == [1, 2, 5, 7]
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in got.collect())
    assert simhash.keep_first(docs.limit(0)).count() == 0
