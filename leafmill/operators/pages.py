"""Predicates over fetched pages, one column each; the names say that they only suspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.html import first_tag, flat_node, inner_text, selector_fault, without
from ..functions.text import any_of, squeeze


def visible_text(page: Column) -> Column:
    """All text of a page in one line, script and style texts included as parsers give them, comments not."""
    return squeeze(F.regexp_replace(without(page, r"(?s)<!--.*?-->", r"(?s)<![^>]*>"), r"(?s)<[^>]+>", " "))


def page_quality(pages: DataFrame, page: str = "html") -> DataFrame:
    """bad_suspect, error_suspect, challenge_suspect of each page."""
    p = F.coalesce(F.col(page), F.lit(""))
    out = pages.withColumns({"__title": F.lower(F.coalesce(inner_text(first_tag(p, "title")), F.lit(""))), "__body": visible_text(p)})
    head = lambda n: F.lower(F.left("__body", F.lit(n)))
    title = F.col("__title")
    wrapper = F.lit(False)
    for w in fixed.CHALLENGE_WRAPPERS:
        wrapper = wrapper | p.rlike(rf"(?i)(class|id)=[\"'][^\"']*\b{w}\b")
    return out.withColumns(
        {
            "bad_suspect": (F.char_length(squeeze(p)) < 200) | any_of(title, fixed.BAD_PAGE_SIGNALS) | any_of(head(300), fixed.BAD_PAGE_SIGNALS),
            "error_suspect": any_of(title, fixed.ERROR_TITLE_SIGNALS) | any_of(head(500), fixed.ERROR_BODY_SIGNALS),
            "challenge_suspect": any_of(title, fixed.CHALLENGE_TITLE_SIGNALS) | any_of(head(500), fixed.CHALLENGE_BODY_SIGNALS) | ((F.char_length(p) < 1500) & wrapper),
        }
    ).drop("__title", "__body")


def usable(status: Column, body: Column) -> Column:
    """Good in spite of an HTTP error: the status is below 400 or there is a body worth reading."""
    return (status < 400) | (F.char_length(squeeze(body)) > 500)


def retriable(status: Column) -> Column:
    return status.isin(*fixed.RETRIABLE_STATUS)


def retriable_model_error(message: Column) -> Column:
    return message.rlike("(?i)429|503|500|rate|internal")


def page_metadata(pages: DataFrame, site_name: Column, page: str = "html", title_tag: str = "h1") -> DataFrame:
    """title (the site's name if the page has none) and its length."""
    from ..functions.text import normalize_text, optional

    return pages.withColumn("title", F.coalesce(optional(normalize_text(inner_text(first_tag(F.col(page), title_tag)))), site_name))


def cover_url(attrs: Column, style: Column, page_url: Column) -> Column:
    """From a map of an image's attributes in their order of worth, then srcset, then a style's url()."""
    from ..functions.text import css_url, first_srcset, optional
    from ..functions.urls import urljoin

    found = F.coalesce(*[optional(F.try_element_at(attrs, F.lit(a))) for a in fixed.COVER_ATTRS], first_srcset(F.try_element_at(attrs, F.lit("srcset"))), css_url(style))
    return F.when(found.isNotNull(), urljoin(page_url, found))


def selector_issues(report: DataFrame) -> DataFrame:
    """Rows (selector_key, selector, matches): those whose selector is set and matches nothing, or isn't understood (matches is null)."""
    issue = F.when(F.col("matches") == 0, F.concat("selector_key", F.lit(" matches 0 elements"))).when(F.col("matches").isNull(), F.concat("selector_key", F.lit(": "), selector_fault(F.col("selector"))))
    return report.filter(F.col("selector").isNotNull() & (F.coalesce("matches", F.lit(0)) == 0)).withColumn("issue", issue)


__all__ = ["cover_url", "flat_node", "page_metadata", "page_quality", "retriable", "retriable_model_error", "selector_issues", "usable", "visible_text"]
