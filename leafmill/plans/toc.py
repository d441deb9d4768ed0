"""From table-of-contents pages to an ordered chapter list."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.html import anchors
from ..functions.text import chapter_number, is_notice
from ..functions.urls import authority, urljoin


def links(pages: DataFrame, base: str = "url", page: str = "html") -> DataFrame:
    """Every anchor: pos, href, url (resolved), title (the URL if the text is blank)."""
    out = anchors(pages, page).withColumn("link_url", urljoin(F.col(base), F.col("href")))
    return out.withColumn("title", F.coalesce(F.nullif("link_text", F.lit("")), "link_url"))


def same_domain(url: Column, start_url: Column) -> Column:
    """Exact equality of authorities, letters' case and port included."""
    return authority(url) == authority(start_url)


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the order has to be total for one answer. An aggregate, so a key that many rows
    have is combined where they lie."""
    row = F.min_by(F.struct("*"), F.struct(*order)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(row).select("row.*")


def likely_chapters(items: DataFrame, group: list[str], title: Column) -> DataFrame:
    """Without notices; where a group has titles with explicit numbers, those alone."""
    out = items.withColumn("chapter_no", chapter_number(title)).filter(~is_notice(title))
    # the order below needs a group's rows together anyway; the same exchange serves both
    some = F.max(F.col("chapter_no").isNotNull()).over(Window.partitionBy(*group))
    return out.withColumn("__some", some).filter(~F.col("__some") | F.col("chapter_no").isNotNull()).drop("__some")


def order_chapters(items: DataFrame, group: list[str], idx: str, reverse: bool = False) -> DataFrame:
    """position from 1: by number if every item of the group has one (ties by idx, always rising), else by idx."""
    every = F.bool_and(F.col("chapter_no").isNotNull()).over(Window.partitionBy(*group))
    sign = -1 if reverse else 1
    out = items.withColumn("__every", every)
    key = F.when(F.col("__every"), F.col("chapter_no") * sign).otherwise(F.col(idx) * sign)
    w = Window.partitionBy(*group).orderBy(key, F.col(idx))
    return out.withColumn("position", F.row_number().over(w).cast("long")).drop("__every")


def walk(spark: SparkSession, starts: DataFrame, edges: DataFrame, max_pages: int = 50) -> DataFrame:
    """Pages that a start reaches by next-links, with page_no from 1. starts: (start, page);
    edges: (page, next_page), one per page at most. Ends where there is no link, the page was
    seen, or max_pages are reached."""
    most = max(1, int(max_pages))
    # the pages after each page, by doubling: a path goes on with the path of its last page. Each
    # round is kept, as the next one reads it twice
    paths = edges.filter("next_page IS NOT NULL").select("page", F.array("next_page").alias("path"))
    steps = 1
    while steps < most - 1:
        paths = paths.persist(StorageLevel.MEMORY_AND_DISK)
        on = paths.select(F.col("page").alias("__last"), F.col("path").alias("__rest"))
        longer = F.coalesce(F.concat("path", "__rest"), F.col("path"))
        paths = paths.join(on, F.element_at("path", -1) == F.col("__last"), "left").select("page", F.slice(longer, 1, most - 1).alias("path"))
        steps *= 2
    own = F.array("page").cast(ArrayType(starts.schema["page"].dataType))
    after = F.col("path").cast(ArrayType(starts.schema["page"].dataType))
    walked = F.slice(F.coalesce(F.concat(own, after), own), 1, most)
    out = starts.join(paths, "page", "left").select("start", walked.alias("walked"))
    # one next page each, so after the first page that was seen all are: the different ones are the first ones
    out = out.select("start", F.posexplode(F.slice("walked", F.lit(1), F.size(F.array_distinct("walked")))).alias("n", "page"))
    return out.select("start", "page", (F.col("n") + 1).cast("long").alias("page_no"))


def discover(pages: DataFrame, group: list[str], page_order: str, base: str = "url", within_domain: bool = True, likely: bool = True, reverse: bool = False) -> DataFrame:
    """The whole plan: links of a site's pages, first of each URL, likely chapters, ordered."""
    out = links(pages, base)
    if within_domain:
        out = out.filter(same_domain(F.col("link_url"), F.col(base)))
    out = first_wins(out, [*group, "link_url"], [page_order, "pos"])
    out = out.withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy(page_order, "pos")))
    out = likely_chapters(out, group, F.col("title")) if likely else out.withColumn("chapter_no", chapter_number(F.col("title")))
    return order_chapters(out, group, "idx", reverse)
