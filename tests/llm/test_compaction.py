import datetime
import hashlib
import math
import random
import zlib
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from leafmill.llm import compaction, storage

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"
EPOCH = datetime.datetime(1970, 1, 1)


def brute(rows):
    """(day, lot, piece, n_rows, min, max, cents, sources, ids_sha256, rewritten) of each file, by the rules in plain Python."""
    share = lambda x: 1 + len(rows) // x
    days = {}
    for r in rows:
        days.setdefault(None if r[2] is None else (r[2] - EPOCH).days, []).append(r)
    out = []
    for day, own in days.items():
        files = {}
        for r in own:
            h = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            files.setdefault((h // 16 % (1 + len(own) // share(200)), min(h % 4, h // 4 % 4)), []).append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[2] is not None, r[2] or EPOCH, r[0] is not None, r[0] or 0))
        small = sorted((k for k in files if len(files[k]) < share(750)), key=lambda k: (-len(files[k]), *k))
        groups = []
        for k in small:
            to = next((g for g in groups if sum(len(files[x]) for x in g) + len(files[k]) <= share(300)), None)
            if to is None:
                groups.append([k])
            else:
                to.append(k)
        for g in [*groups, *([k] for k in files if k not in small)]:
            held = [r for k in g for r in files[k]]
            ids = [r[0] for r in held if r[0] is not None]
            cents = sum(math.floor(100 * r[4] + 0.5) for r in held if r[4] is not None and math.isfinite(r[4]))
            digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in held).encode()).hexdigest()
            out.append((day, *g[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), digest, len(g) > 1))
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows on one day
        day = 40 if rng.random() < 0.33 else rng.randrange(20, 50)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, seconds=rng.randrange(40) * 1800)
        rows.append((i, at, at, rng.choice((None, "view", "buy")), rng.choice((None, 0.005, 12.34, -7.125, 1e6))))
    rows += rows[:: n // 20 or 1]
    rows += [(None, None, None, None, None), (n + 1, None, None, "x", 1.0), (None, rows[0][1], rows[0][2], "y", float("nan")), (n + 2, rows[0][1], rows[0][2], "y", float("inf"))]
    return rows


def test_against_brute_force(spark, tmp_path):
    for n, seed in ((2000, 1), (900, 2)):
        rows = made(n, seed)
        docs = spark.createDataFrame(rows, CLICKS).repartition(5)
        folder = compaction.write_lots(docs, str(tmp_path / f"t{n}"), "arrived_at", "click_id")
        before = {p: p.read_bytes() for p in Path(folder.path).rglob("*.parquet")}
        planned = compaction.plan(spark, folder)
        compaction.execute(spark, folder, planned)
        found = compaction.described(spark, folder, planned, "click_id", F.col("value")).collect()
        got = [(r.day, r.lot, r.piece, r.n_rows, r.least, r.largest, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in found]
        assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
        assert any(r[-1] for r in got) and not all(r[-1] for r in got)
        assert {r.columns for r in found} == {"click_id,ts,arrived_at,kind,value"}
        # the folder has these files and no others; those that weren't rewritten are the ones from before
        left = set(Path(folder.path).rglob("*.parquet"))
        assert {Path(urlsplit(r.path).path) for r in found} == left
        for r in found:
            p = Path(urlsplit(r.path).path)
            assert (p in before) == (not r.rewritten)
            if not r.rewritten:
                assert p.read_bytes() == before[p]
            assert pq.ParquetFile(p).schema_arrow.names == ["click_id", "ts", "arrived_at", "kind", "value"]
        # what the files hold is what came in
        assert sorted(map(repr, map(tuple, folder.read(spark).select(*docs.columns).collect()))) == sorted(map(repr, rows))
        compaction._deleted(iter([]))  # deleting again what is gone is no fault
        planned.filter("joined > 1").select("path").mapInArrow(compaction._deleted, "path string").collect()


def test_lockstep_is_first_fit():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(0, 50, (20, 40)), axis=1)[:, ::-1]
    got = compaction.lockstep(sizes, 100)
    for row, groups in zip(sizes, got):
        room = []
        for size, g in zip(row, groups):
            if not size:
                assert g == -1
                continue
            want = next((i for i, x in enumerate(room) if x >= size), len(room))
            if want == len(room):
                room.append(100)
            room[want] -= size
            assert g == want
    assert compaction.lockstep(np.zeros((3, 0), np.int64), 5).shape == (3, 0)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], CLICKS)
    folder, planned = compaction.compact(docs, storage.new_path(spark, "t"), "arrived_at", "click_id")
    assert compaction.described(spark, folder, planned, "click_id", F.col("value")).collect() == []
    rows = made(200, 5)
    wide = spark.createDataFrame(rows, CLICKS).withColumns({c: F.lit(7) for c in ("day", "lot", "piece", "row", "path", "seq", "__lot", "at", "to_lot", "Key")} | {"held": F.create_map(F.lit("a"), F.lit(1)), "a.b": F.lit(1)})
    folder, planned = compaction.compact(wide, storage.new_path(spark, "t"), "arrived_at", "click_id")
    found = compaction.described(spark, folder, planned, "click_id", F.col("value")).collect()
    assert {(r.day, r.lot, r.piece, r.ids_sha256) for r in found} == {(*x[:3], x[8]) for x in brute(rows)}
    assert {r.columns for r in found} == {",".join(wide.columns)}
