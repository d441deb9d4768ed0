import hashlib
import random
import zlib

from pyspark.sql import functions as F

from leafmill.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(r, text):
    shown = ["-" if x is None else str(x) for x in (r[0], r[3], r[2], r[4], text)]
    return h(*("-" if x is None else f"{len(s.encode())}:{s}" for x, s in zip((r[0], r[3], r[2], r[4], text), shown)))


def climb(nodes):
    """Levels from the nodes up to their root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h(*at[i : i + 3]) for i in range(0, len(at), 3)])
    return levels


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, fields(r, r[1])))
        built[s] = own, climb([fields(r, r[1]) for r in own])
    top = climb([built[s][1][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        own, levels = built[s]
        for pos, r in enumerate(own):
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            text = r[1] if odd or r[1] is None else r[1].replace("\n", "")
            cur, proof = fields(r, text), ""
            for tree, at in ((levels, pos), (top, n)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    left, right = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
                    proof, cur, at = proof + left + right, h(left, cur, right), at // 3
            out.append((r[0], levels[0][pos], levels[-1][0], top[-1][0], h(proof), cur, cur == top[-1][0]))
    return out


def found(docs):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return [tuple(r) for r in merkle.audit(docs, tampered, F.replace("text", F.lit("\n"), F.lit(""))).collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice((None, "", "a", "a", "a", "a", "a", "é", "z", "lone" if i == 7 else "b"))
        rows.append((i, rng.choice((None, "", "no break", "a\nb\n", "Grüße\n\n€")), rng.choice((None, "en", "de")), source, rng.choice((None, 0, 12))))
    # rows that repeat, null ids, one id with two texts
    rows += [rows[5], rows[5], (None, "x\n", "en", "a", 1), (None, "y", None, "a", 1), (9, "other\n", "en", "a", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = found(docs)
    assert in_order(got) == in_order(brute(rows))
    assert {r[6] for r in got} == {True, False}


def test_small_tables_and_clashing_names(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    one = [(4, "a\nb" * 30_000, "en", None, 5)]
    names = ("g", "pos", "size", "digest", "part", "seq", "key", "grp", "leaf", "moved", "root")
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in one], DOCS + "".join(f", {n} int" for n in names))
    assert found(wide) == brute(one)
    # sources of each size about the powers of three
    rows = [(100 * n + i, f"t{i}\n", "en", f"s{n}", i) for n in (1, 2, 3, 4, 9, 10, 27, 28) for i in range(n)]
    assert in_order(found(spark.createDataFrame(rows, DOCS))) == in_order(brute(rows))


def test_a_proof_leads_to_the_root_alone_from_its_own_leaf(spark):
    rows = spark.range(40).select("id", F.lit("s").alias("s"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    proofs, root = merkle.manifest(rows, "s", "id", "d", fan=4)
    other = F.unhex(F.sha2(F.lit("x"), 256))
    seen = proofs.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("own"), merkle.folded(other, F.col("proof")).alias("other")).collect()
    assert len(seen) == 40 and all(r.own == root and r.other != root for r in seen)
