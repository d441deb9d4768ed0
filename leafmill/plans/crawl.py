"""Planning and accounting of a run: what is there, what fits the quota, what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import first_tag, flat_node, inner_text, plain_text, without
from ..functions.text import normalize_text, optional


def extract_chapter(pages: DataFrame, content: str = "article", title: str = "h1", remove=(), page: str = "html") -> DataFrame:
    """title (before removals), body as plain text, and error where there is no content."""
    markup = first_tag(without(F.col(page), *remove), content)
    out = pages.withColumn("title", optional(normalize_text(inner_text(first_tag(F.col(page), title))))).withColumn("body", plain_text(markup))
    return out.withColumn("error", F.when(F.col("body").isNull(), "content node not found").when(F.col("body") == "", "content is empty"))


DEFAULT_REMOVE = (flat_node("div", r"class=[\"']ad[\"']"), flat_node("footer"), flat_node("script"), flat_node("style"))


def first_valid(attempts: DataFrame, key: str = "url", valid: Column | None = None) -> DataFrame:
    """Of several attempts at a page the first valid one."""
    w = Window.partitionBy(key).orderBy("attempt")
    return attempts.filter(F.col("ok") if valid is None else valid).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def resume(discovered: DataFrame, existing: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """discovered with `skipped`: whether a non-empty output exists already. existing: (key, n_bytes)."""
    there = existing.filter("n_bytes > 0").select(key).distinct().withColumn("__there", F.lit(True))
    out = discovered.join(there, key, "left")
    return out.withColumn("skipped", F.lit(False) if overwrite else F.coalesce("__there", F.lit(False))).drop("__there")


def quota(rows: DataFrame, group: list[str], order: str, success: Column, most: int | None) -> DataFrame:
    """Rows that a run considers: those with fewer than `most` successes before them. Skips and failures take none of the quota."""
    if most is None:
        return rows
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__done", F.coalesce(F.sum(success.cast("int")).over(before), F.lit(0))).filter(F.col("__done") < most).drop("__done")


def manifest(outcomes: DataFrame, discovered: DataFrame, group: list[str]) -> DataFrame:
    """Counters of a run. outcomes: rows with status fetched, skipped or failed."""
    done = outcomes.groupBy(*group).agg(
        F.count("*").alias("completed_chapters"),
        F.count_if(F.col("status") == "fetched").alias("fetched_chapters"),
        F.count_if(F.col("status") == "skipped").alias("skipped_chapters"),
        F.count_if(F.col("status") == "failed").alias("failed_chapters"),
    )
    total = discovered.groupBy(*group).agg(F.count("*").alias("total_chapters"))
    return total.join(done, group, "left").na.fill(0)


def manifest_document(outcomes: DataFrame, group: list[str]) -> DataFrame:
    """One nested row for each group: chapters and errors in order of index."""
    chapter = F.struct("index", "title", "url", (F.col("status") == "skipped").alias("skipped"))
    error = F.struct("index", "url", "error")
    return outcomes.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(F.col("status") != "failed", chapter))).alias("chapters"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", error))).alias("errors")
    )


def reconcile(attempted: DataFrame, recorded: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """After an interruption: attempted, not recorded, yet written."""
    return attempted.join(recorded.select(key), key, "left_anti").join(on_disk.select(key), key, "left_semi")


def progress_line(current: Column, total: Column, status: Column, title: Column) -> Column:
    label = F.when(status == "started", "fetching").when(status == "fetched", "last").otherwise(status)
    return F.concat(F.lit("["), current.cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), label, F.lit(": "), title)


def preview(chapters: DataFrame, group: list[str], order: str, most: int = 10) -> DataFrame:
    """The first `most` of each group and how many more there are."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy(order))
    return chapters.withColumns({"n": n.cast("long"), "more": F.greatest(F.count("*").over(w) - most, F.lit(0))}).filter(F.col("n") <= most)


def referers(requests: DataFrame) -> DataFrame:
    """requests (worker, ts, url) with the worker's previous URL and the gap to it in seconds."""
    w = Window.partitionBy("worker").orderBy("ts", "request_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return requests.withColumns({"referer": F.lag("url").over(w), "gap_seconds": (at - F.lag(at).over(w)) / 1e6})
