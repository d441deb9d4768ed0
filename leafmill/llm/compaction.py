"""Small files of a table by day: written, packed and put together.

A table of R rows is written below a folder with one file for each day, lot and piece. Sizes go with the
table: share(x) is 1 + floor(R / x) rows. A day of r rows has 1 + floor(r / share(200)) lots; a lot has four pieces, of falling size. Within a day, files of
under share(750) rows, the larger first, each join the earliest-opened group that then holds at most share(300) rows. Every group of several
files becomes one file, its rows in joining order; the other files are not touched.

How the groups are found: days are dealt out in blocks of DAYS. A block is a matrix of its days by the ranks of their files, and another of its
days by the rows that each group still has room for. Rank by rank, one boolean argmax finds for all days at once the first group with room; groups that aren't open yet have all
their room and stand last, so the first that fits is the earliest opened or a new one. No day has over 804 small files, since lots are shares of the table.

What is broadcast: the rows of days with more than one lot, of which there are fewer than 200 whatever the table. All else is shuffled: rows to their file's task, sizes to their
block's, the plan to the rows that move. A file is written by one task, streaming. The plan is a table; new files are committed before old ones are deleted, and deletion, which tasks do by themselves, can be done again.

Contract for odd input: a null time is a day of its own (null), a null key has the checksum of an empty text and is an empty text among the
ids; rows that repeat stand beside each other; rows of equal time and key stand in the order of their other columns; an amount that is null, infinite or no number
counts as nothing; an empty table leaves an empty folder; columns may have any names but `_metadata`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructType, VariantType

from . import storage

#: The table's rows through these: a lot's rows, the most of a group, and what a small file stays under.
LOT, GROUP, SMALL = 200, 300, 750
#: Consecutive days that one task packs at once.
DAYS = 32
_PLAN = "day long, lot long, piece long, n_rows long, path string, to_lot long, to_piece long, seq long, joined long"


def share(rows: int, of: int) -> int:
    return 1 + rows // of


@dataclass(frozen=True)
class Folder:
    """A table in a folder: its columns, the names that the folder gives day, lot and piece, and how many rows it has."""

    path: str
    schema: StructType
    names: tuple[str, str, str]
    rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        whole = StructType([*self.schema.fields])
        for n in self.names:
            whole = whole.add(n, LongType())
        return spark.read.schema(whole).parquet(self.path)


def _names(columns: list[str]) -> tuple[str, str, str]:
    taken, out = {c.lower() for c in columns}, []
    for n in ("day", "lot", "piece"):
        while n in taken:
            n += "_of_file"
        out.append(n)
    return tuple(out)


def _order(schema: StructType, first: list[str]) -> list[str]:
    plain = [f.name for f in schema if not isinstance(f.dataType, MapType | VariantType) and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return [*first, *[c for c in plain if c not in first]]


def write_lots(rows: DataFrame, path: str, time: str, key: str) -> Folder:
    """Write rows below path with a file for each day, lot and piece, each in the order of time and key."""
    day, lot, piece = names = _names(rows.columns)
    day_of = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    counts = storage.materialize(rows.groupBy(day_of(time).alias("d")).agg(F.count("*").alias("r")), "compaction_days")
    total = counts.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    lot_rows = share(total, LOT)
    # days of share(200) rows or more: fewer than 200, for they have more than R rows together otherwise
    large = counts.filter(F.col("r") >= lot_rows)
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    dealt = rows.withColumns({day: day_of(time), piece: F.least(h % 4, F.floor(h / 4) % 4).cast("long"), lot: F.floor(h / 16).cast("long")})
    dealt = dealt.join(F.broadcast(large.select(F.col("d").alias("__d"), F.col("r").alias("__r"))), F.col(day).eqNullSafe(F.col("__d")), "left")
    dealt = dealt.withColumn(lot, F.col(lot) % (1 + F.floor(F.coalesce("__r", F.lit(0)) / lot_rows))).select(*[F.col(f"`{c}`") for c in rows.columns], *names)
    tasks = storage.partitions_for(rows, factor=2)
    dealt = dealt.repartition(tasks, *names).sortWithinPartitions(*names, *[F.col(f"`{c}`") for c in _order(rows.schema, [time, key])])
    dealt.write.option("maxRecordsPerFile", 0).partitionBy(*names).parquet(path)
    return Folder(path, rows.schema, names, total)


def lockstep(sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each file: sizes is a matrix of days by ranks, 0 where a day has no more files, and so is what comes back, -1 there."""
    days, ranks = sizes.shape
    room = np.full((days, max(1, ranks)), most, np.int64)
    groups = np.full(sizes.shape, -1, np.int64)
    for k in range(ranks):
        size = sizes[:, k]
        at = (room >= size[:, None]).argmax(axis=1)
        live = np.flatnonzero(size)
        room[live, at[live]] -= size[live]
        groups[live, k] = at[live]
    return groups


def _packed(files: pa.Table, most: int, small: int) -> pa.Table:
    """A block's files with the group that each joins (named by its first file), its place there and how many join."""
    n = len(files)
    day = files["day"].fill_null(np.iinfo(np.int64).min).to_numpy()
    lot, piece, rows = (files[c].to_numpy() for c in ("lot", "piece", "n_rows"))
    order = np.lexsort((piece, lot, -rows, day))
    order = order[rows[order] < small]
    to_lot, to_piece, seq, joined = lot.copy(), piece.copy(), np.zeros(n, np.int64), np.ones(n, np.int64)
    if len(order):
        _, at_day = np.unique(day[order], return_inverse=True)
        start = np.searchsorted(at_day, np.arange(at_day[-1] + 1))
        rank = np.arange(len(order)) - start[at_day]
        sizes = np.zeros((at_day[-1] + 1, rank.max() + 1), np.int64)
        sizes[at_day, rank] = rows[order]
        group = at_day * sizes.shape[1] + lockstep(sizes, most)[at_day, rank]
        by = np.argsort(group, kind="stable")  # ranks rise within a group
        _, first, index, count = np.unique(group[by], return_index=True, return_inverse=True, return_counts=True)
        seq[order[by]] = np.arange(len(by)) - first[index]
        joined[order[by]] = count[index]
        to_lot[order[by]], to_piece[order[by]] = lot[order[by[first]]][index], piece[order[by[first]]][index]
    added = {"to_lot": to_lot, "to_piece": to_piece, "seq": seq, "joined": joined}
    return pa.table([*(files[c] for c in ("day", "lot", "piece", "n_rows", "path")), *map(pa.array, added.values())], ["day", "lot", "piece", "n_rows", "path", *added])


def plan(spark: SparkSession, folder: Folder) -> DataFrame:
    """A row per file of the folder: day, lot, piece, n_rows, path; to_lot and to_piece, which name the file it goes into; seq, its place there; joined, how many go there."""
    day, lot, piece = folder.names
    most, small = share(folder.rows, GROUP), share(folder.rows, SMALL)
    files = folder.read(spark).groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
    blocks = files.withColumn("block", F.floor(F.col("day") / DAYS)).groupBy("block")
    return storage.materialize(blocks.applyInArrow(lambda t: _packed(t, most, small), _PLAN), "compaction_plan")


def execute(spark: SparkSession, folder: Folder, planned: DataFrame) -> None:
    """Write one file for each group of several, then delete what they replace."""
    names = folder.names
    moving = planned.filter("joined > 1")
    goes = moving.select(*[F.col(c).alias(f"__{c}") for c in ("day", "lot", "piece", "to_lot", "to_piece", "seq")]).hint("merge")
    rows = folder.read(spark).select(F.struct(*[F.col(f"`{c}`") for c in folder.schema.names]).alias("row"), *[F.col(n).alias(f"__from{i}") for i, n in enumerate(names)], F.col("_metadata.row_index").alias("__at"))
    met = rows.join(goes, F.col("__from0").eqNullSafe(F.col("__day")) & (F.col("__from1") == F.col("__lot")) & (F.col("__from2") == F.col("__piece")))
    met = met.select("row", *[F.col(c).alias(n) for c, n in zip(("__from0", "__to_lot", "__to_piece"), names)], "__seq", "__at")
    met = met.repartition(storage.partitions_for(rows, factor=2), *names).sortWithinPartitions(*names, "__seq", "__at")
    met.select("row.*", *names).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(*names).parquet(folder.path)
    # an action for its effect: a row per deleted file
    moving.select("path").mapInArrow(_deleted, "path string").write.format("noop").mode("overwrite").save()


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            where, _, name = path.rpartition("/")
            for one in (path, f"{where}/.{name}.crc"):  # the checksum file that some stores keep beside
                if store.get_file_info(one).type != fs.FileType.NotFound:
                    store.delete_file(one)
        yield batch


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per file from its rows in order: path, day, lot, piece, n_rows, least and largest key, cents, ids_sha256."""
    at, digest, low, high, rows, cents = None, None, [], [], 0, 0

    def closed() -> pa.RecordBatch:
        key = shape.field("key").type
        least, most = (pc.min(pa.array(x, key)).as_py() if f == "min" else pc.max(pa.array(x, key)).as_py() for f, x in (("min", low), ("max", high)))
        found = (at[0], at[1], at[2], at[3], rows, least, most, cents, digest.hexdigest())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), key, key, pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(found, kinds)], ["path", "day", "lot", "piece", "n_rows", "least", "largest", "cents", "ids_sha256"])

    for batch in batches:
        shape = batch.schema
        paths = batch.column("path")
        n = len(batch)
        runs = pc.run_end_encode(paths)
        start = 0
        for end in runs.run_ends.to_pylist() if n else []:
            part = batch.slice(start, end - start)
            path = part.column("path")[0].as_py()
            if at is None or at[0] != path:
                if at is not None:
                    yield closed()
                at = (path, *(part.column(c)[0].as_py() for c in ("day", "lot", "piece")))
                digest, low, high, rows, cents = hashlib.sha256(), [], [], 0, 0
            ids = ["" if x is None else str(x) for x in part.column("key").to_pylist()]
            digest.update(("," if rows else "").encode() + ",".join(ids).encode())
            both = pc.min_max(part.column("key")).as_py()
            low, high = [*low, both["min"]], [*high, both["max"]]
            low, high = [pc.min(pa.array(low, shape.field("key").type)).as_py()], [pc.max(pa.array(high, shape.field("key").type)).as_py()]
            rows += end - start
            cents += pc.sum(part.column("cents")).as_py() or 0
            start = end
    if at is not None:
        yield closed()


def described(spark: SparkSession, folder: Folder, planned: DataFrame, key: str, amount: Column) -> DataFrame:
    """A row per file that the folder holds, read back from it: day, lot, piece, n_rows, least, largest, cents (the sum of floor(100 * amount + 0.5)), sources, ids_sha256, columns, path,
    rewritten."""
    day, lot, piece = folder.names
    cents = F.when(F.abs(amount) < float("inf"), F.floor(100 * amount + F.lit(0.5)))
    kind = folder.schema[key].dataType.simpleString()
    rows = folder.read(spark).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col(key).alias("key"), cents.alias("cents"))
    rows = rows.repartition(storage.partitions_for(rows), "path").sortWithinPartitions("path", "at").drop("at")
    found = rows.mapInArrow(_digests, f"path string, day long, lot long, piece long, n_rows long, least {kind}, largest {kind}, cents long, ids_sha256 string")
    names = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("-", F.col("lot").cast("string"), F.col("piece").cast("string")).alias("name")))), lambda x: x["name"])
    sources = planned.groupBy(F.col("day").alias("of_day"), F.col("to_lot").alias("of_lot"), F.col("to_piece").alias("of_piece")).agg(F.array_join(names, ",").alias("sources"), (F.count("*") > 1).alias("rewritten")).hint("merge")
    met = found.join(sources, F.col("day").eqNullSafe(F.col("of_day")) & (F.col("lot") == F.col("of_lot")) & (F.col("piece") == F.col("of_piece")))
    return met.select("day", "lot", "piece", "n_rows", "least", "largest", "cents", "sources", "ids_sha256", F.lit(",".join(folder.schema.names)).alias("columns"), "path", "rewritten")


def compact(rows: DataFrame, path: str, time: str, key: str) -> tuple[Folder, DataFrame]:
    """Write rows below path and put their small files together there: the folder, and the plan that was followed."""
    spark = rows.sparkSession
    folder = write_lots(rows, path, time, key)
    planned = plan(spark, folder)
    execute(spark, folder, planned)
    return folder, planned
