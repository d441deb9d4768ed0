"""Incremental runs: a folder of page files to chapters and a manifest, resumable at every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.crawl import DEFAULT_REMOVE, extract_chapter
from ..plans.toc import first_wins

PAGES = "page_id long, url string, html string"


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Page files as they arrive; at most so many in a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _existing(spark: SparkSession, out: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*"))
    return spark.read.parquet(out) if found is not None and len(found) else None


def latest(rows: DataFrame) -> DataFrame:
    """One row per URL over all batches: the fetched one if there is one, else a failure, else what waits for quota."""
    rank = F.when(F.col("status") == "fetched", 2).when(F.col("status") == "failed", 1).otherwise(0)
    columns = [F.max_by(F.col(c), F.struct(rank, -F.col("page_id"))).alias(c) for c in rows.columns if c != "url"]
    return rows.groupBy("url").agg(*columns)


def _write(spark: SparkSession, pages: DataFrame, out: str, n: int, most: int | None) -> None:
    """Extract pages as batch n. A URL that is fetched already is left out, one that failed before is tried anew;
    what the quota does not let in is kept with its markup until it does."""
    rows = first_wins(pages, ["url"], ["page_id"])
    done = 0
    old = _existing(spark, out)
    if old is not None:
        fetched = old.filter(f"batch <> {n} AND status = 'fetched'").select("url").distinct()
        rows = rows.join(fetched, "url", "left_anti")
        done = fetched.count() if most is not None else 0
    got = extract_chapter(rows, remove=DEFAULT_REMOVE).withColumn("status", F.when(F.col("error").isNull(), "fetched").otherwise("failed"))
    if most is not None:
        # a batch is a few files, so its running count of successes is one task's
        before = Window.partitionBy(F.lit(0)).orderBy("page_id", "url").rowsBetween(Window.unboundedPreceding, -1)
        got = got.withColumn("status", F.when(F.coalesce(F.sum((F.col("status") == "fetched").cast("int")).over(before), F.lit(0)) + done >= most, "pending").otherwise(F.col("status")))
    waits = F.col("status") == "pending"
    own = [F.when(~waits, F.col(c)).alias(c) for c in ("title", "body")]
    got.select("page_id", "url", *own, "status", F.when(~waits, F.col("error")).alias("error"), F.when(waits, F.col("html")).alias("html")).write.mode("overwrite").parquet(f"{out}/batch={n}")


def run(
    spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 8, most: int | None = None, on_batch: Callable[[int, DataFrame], None] | None = None
) -> StreamingQuery:
    """Extract what is new in the landing folder. The first page of a URL wins, over all batches;
    a batch that is run again replaces its own output. `most` bounds the chapters fetched over all runs: failures and
    skipped pages take none of it, and pages beyond it wait for a run that allows more."""

    def write(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        _write(s, batch, out, n, most)
        if on_batch:
            on_batch(n, snapshot(s, out))

    old = _existing(spark, out)
    if old is not None:
        waiting = latest(old).filter("status = 'pending'").select("page_id", "url", "html")
        if waiting.take(1):
            # a batch of its own, numbered downwards from -1 so that the stream's own batches keep theirs
            _write(spark, waiting, out, min(old.agg(F.min("batch")).first()[0], 0) - 1, most)
    stream = read_landing(spark, landing, files_per_batch)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The manifest counters of all batches so far; what waits is not completed."""
    rows = latest(spark.read.parquet(out).select("page_id", "url", "status")).filter("status <> 'pending'")
    return rows.agg(F.count("*").alias("completed_chapters"), F.count_if(F.col("status") == "fetched").alias("fetched_chapters"), F.count_if(F.col("status") == "failed").alias("failed_chapters"))
