"""A cache of pages as a keyed store of segments: a put writes its own rows alone, the latest one of a key counts, compaction folds segments together.

A segment is a folder `v=<number>` of Parquet files by bucket of the key. Only finished segments are read (those that Spark has marked), so a put that fails changes
nothing. A dropped key is a row that says so. Compaction writes the latest rows of all segments as one that has their highest number, and takes the old ones away
after it is there; whoever reads in between sees the same rows twice, which changes nothing. A lookup reads the buckets of the keys that it is asked for.

Contract for odd input: a null key is left out; a null body is a dropped key; of rows of one put with one key the longest body counts (ties: the greater text);
an empty store has no rows. One driver writes at a time; any number read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class SegmentedCache:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self._spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _fs(self):
        where = self._spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def segments(self) -> list[tuple[int, str]]:
        """(number, name) of the finished segments, rising."""
        done = self._fs().globStatus(self._path("v=*/_SUCCESS"))
        names = [x.getPath().getParent().getName() for x in done or []]
        return sorted((int(re.match(r"v=(\d+)", n)[1]), n) for n in names)

    def _write(self, rows: DataFrame, number: int) -> None:
        out = rows.withColumn("bucket", self._bucket(F.col("key")))
        # a bucket is a file of a few at most
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/v={number:012d}-{uuid.uuid4().hex}")

    def _next(self) -> int:
        return max((n for n, _ in self.segments()), default=0) + 1

    def put(self, new: DataFrame) -> None:
        """Bodies (key, body) in place of what the keys had."""
        own = new.filter("key IS NOT NULL").groupBy(F.col("key").cast("string").alias("key")).agg(F.max_by(F.col("body").cast("string"), F.struct(F.length("body"), "body")).alias("body"))
        self._write(own, self._next())

    def drop(self, keys: DataFrame) -> None:
        """Forget keys."""
        self._write(keys.filter("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("body")).distinct(), self._next())

    def _rows(self) -> DataFrame:
        """Every row of every segment: key, body, bucket, number."""
        found = [f"{self.folder}/{n}" for _, n in self.segments()]
        shape = "key string, body string, bucket int"
        if not found:
            return self._spark.createDataFrame([], f"{shape}, number long")
        rows = self._spark.read.schema(shape).option("recursiveFileLookup", False).option("basePath", self.folder).schema(f"{shape}, v string").parquet(*found)
        return rows.select("key", "body", "bucket", F.regexp_extract("v", r"^(\d+)", 1).cast("long").alias("number"))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        # a body that is null has to win, too: max_by skips no nulls of what it returns
        return rows.groupBy("bucket", "key").agg(F.max_by("body", "number").alias("body"))

    def read(self) -> DataFrame:
        """The cache as it is: key, body."""
        return self._latest(self._rows()).filter("body IS NOT NULL").select("key", "body")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, body) of those keys that are known; only their buckets are read."""
        asked = keys.select("key").filter("key IS NOT NULL").distinct().withColumn("bucket", self._bucket(F.col("key")))
        return self._latest(self._rows().join(asked, ["bucket", "key"], "left_semi")).filter("body IS NOT NULL").select("key", "body")

    def compact(self) -> int:
        """One segment in place of all; returns how many there were."""
        found = self.segments()
        if len(found) > 1:
            self._write(self.read(), found[-1][0])
            for _, name in found:
                self._fs().delete(self._path(name), True)
        return len(found)
