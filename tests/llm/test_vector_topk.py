import numpy as np

from leafmill.llm import vector_topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(q, tuple(a)) for q, a in ok if q % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    v = vector_topk.integer_vectors(df, "vec_id", "embedding", 256)
    return {tuple(r) for r in vector_topk.top_products(v, F.col("vec_id") % 50 == 0, 5).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 30])).tolist()) for i in range(600)]
    rows += [(600, rows[3][1]), (601, rows[3][1]), (650, [0.0] * 6), (700, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_close_vectors_use_coordinates(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.05).tolist()) for i in range(400)] + [(400 + i, (-base * i).tolist()) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i * 10, rng.normal(size=3).tolist()) for i in range(300)]
    monkeypatch.setattr(vector_topk, "ROUND_ROWS", 7)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (50, [1.0, 2.0, 3.0]), (6, []), (100, [])]
    assert run(spark, rows) == {(0, 1, 5, 256 * 256 * 5), (100, 1, 6, 0)}
    assert run(spark, []) == set()


def test_repeated_ids_and_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "SEEDS", 3)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(50, rows[7][1]), (50, rows[50][1]), (7, rows[7][1])]  # two vectors of one query, one of them twice; a candidate twice
    want = brute_repeats(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = [tuple(r) for r in vector_topk.top_products(vector_topk.integer_vectors(df, "vec_id", "embedding", 256), F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got) == sorted(want)


def brute_repeats(rows, k=5):
    ok = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows]
    out = []
    for q, a in {(q, a) for q, a in ok if q % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_short_buckets_are_not_read(spark):
    """A query's bound from the longest vectors leaves the short ones unread."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * (100 if i < 50 else 0.01)).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    vectors = vector_topk.integer_vectors(df, "vec_id", "embedding", 256).withColumn("norm", F.lit(1.0))
    first = vector_topk._first_bounds(vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), vectors.filter("vec_id = 0").select("vec_id", "v"), 5, 40).first()
    assert first.need > 256 and first.bound > 0
