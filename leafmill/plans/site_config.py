"""Site configs: reading, checking, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import optional
from ..functions.urls import authority

REQUIRED = ("name", "start_url", "chapter_link_selector", "chapter_content_selector")
OPTIONAL = ("novel_title_selector", "author_selector", "illustration_selector", "toc_next_selector", "toc_expand_selector", "chapter_title_selector")
#: Typed defaults of the other members, as SQL literals.
DEFAULTS = {
    "same_domain": ("boolean", "true"),
    "reverse_chapter_order": ("boolean", "false"),
    "filter_non_chapter_links": ("boolean", "true"),
    "request_delay_seconds": ("double", "1.0"),
    "timeout_seconds": ("double", "30.0"),
    "retry_attempts": ("int", "3"),
    "retry_backoff_seconds": ("double", "2.0"),
    "max_toc_pages": ("int", "50"),
    "user_agent": ("string", "'Mozilla/5.0'"),
}


def typed(raw: DataFrame, text: str = "value") -> DataFrame:
    """Configs from JSON text, with `error` for those that aren't valid; a single remove selector counts as a list of one."""
    v = F.try_parse_json(F.col(text))
    get = lambda k, t="string": F.try_variant_get(F.col("__v"), f"$.{k}", t)
    out = raw.withColumn("__v", v)
    cols: dict[str, Column] = {k: F.nullif(get(k), F.lit("")) for k in REQUIRED} | {k: optional(get(k)) for k in OPTIONAL}
    cols |= {k: F.coalesce(get(k, t), F.expr(d).cast(t)) for k, (t, d) in DEFAULTS.items()}
    listed = get("remove_selectors", "array<string>")
    cols["remove_selectors"] = F.coalesce(listed, F.when(get("remove_selectors").isNotNull(), F.array(get("remove_selectors"))), F.array().cast("array<string>"))
    version = F.coalesce(get("version", "int"), F.when(get("version").isNull(), F.lit(1)))
    missing = F.array_compact(F.array(*[F.when(F.nullif(get(k), F.lit("")).isNull(), F.lit(k)) for k in REQUIRED]))
    cols["version"] = F.greatest(version, F.lit(1))
    cols["error"] = (
        F.when(F.col("__v").isNull(), "not a JSON object")
        .when(version.isNull(), "invalid config version")
        .when(version > 1, "unsupported future config version")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required config fields: "), F.array_join(missing, ", ")))
    )
    return out.withColumns(cols).drop("__v")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """All *.json files of a folder, in name order by file_name."""
    return typed(spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("file_name", F.col("_metadata.file_name")))


def remove_list(selectors: Column) -> Column:
    """script and style first where they are missing, then the others; each once, in order of first sight."""
    x = F.coalesce(selectors, F.array(F.lit("script"), F.lit("style")))
    x = F.when(F.array_contains(x, "script"), x).otherwise(F.concat(F.array(F.lit("script")), x))
    x = F.when(F.array_contains(x, "style"), x).otherwise(F.concat(F.slice(x, 1, 1), F.array(F.lit("style")), F.slice(x, F.lit(2), F.size(x))))
    return F.array_distinct(x)


def known_config(pages: DataFrame, configs: DataFrame, url: str = "url") -> DataFrame:
    """pages with the file name of the first config of their domain, null if there is none."""
    first = configs.groupBy(authority(F.col("start_url")).alias("__domain")).agg(F.min("file_name").alias("config_file"))
    return pages.withColumn("__domain", authority(F.col(url))).join(first, "__domain", "left").drop("__domain")


def merged(toc: DataFrame, chapter: DataFrame) -> DataFrame:
    """One config from the two answers of a site (site, answer columns), with defaults for nulls."""
    out = toc.join(chapter, "site", "left")
    return out.select(
        "site",
        F.coalesce("chapter_link_selector", F.lit("a")).alias("chapter_link_selector"),
        F.coalesce("chapter_content_selector", F.lit("body")).alias("chapter_content_selector"),
        remove_list(F.col("remove_selectors")).alias("remove_selectors"),
        F.when(F.col("toc_next_selector").isNull(), 1).otherwise(50).alias("max_toc_pages"),
    )
