"""Page sources: tables, folders, caches, and live fetching behind an injected function."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from http.client import HTTPException, InvalidURL

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed import RETRIABLE_STATUS
from ..functions.text import cache_key
from ..functions.urls import authority
from ..operators.pages import page_quality
from ..operators.robots import allowed

PAGES = "url string, final_url string, status int, content_type string, body string, attempts int, error string"


@dataclass(frozen=True)
class Response:
    """What a fetch function returns."""

    final_url: str
    status: int
    body: str
    content_type: str | None = None


@dataclass(frozen=True)
class Politeness:
    """Retries with linear backoff, and the least gap between starts of requests to one origin."""

    attempts: int = 3
    backoff_seconds: float = 2.0
    delay_seconds: float = 1.0
    sleep: Callable[[float], None] = field(default=time.sleep)
    clock: Callable[[], float] = field(default=time.monotonic)


class Throttle:
    """Keeps the gap between the starts of one origin's requests, every attempt counted."""

    def __init__(self, rules: Politeness):
        self._rules = rules
        self._last: dict[str, float] = {}

    def wait(self, host: str) -> None:
        """Return when a request to host may start; it counts as started then."""
        if host in self._last:
            while (left := self._last[host] + self._rules.delay_seconds - self._rules.clock()) > 0:
                self._rules.sleep(left)
        self._last[host] = self._rules.clock()


def usable_response(r: Response) -> bool:
    return r.status < 400 or len(r.body.strip()) > 500


def _asked(url: str, fetch: Callable[[str], Response]) -> tuple[Response | None, str | None, bool]:
    """(response, error, whether asking again may help) of one request. Whatever the fetch function raises is the row's error."""
    try:
        r = fetch(url)
    except (OSError, TimeoutError, HTTPException, zlib.error, EOFError) as e:  # the connection, or what came over it
        return None, str(e) or type(e).__name__, not isinstance(e, InvalidURL)
    except Exception as e:  # a URL that can't be asked for; asking again doesn't help
        return None, f"{type(e).__name__}: {e}" if str(e) else type(e).__name__, False
    if usable_response(r):
        return r, None, False
    return None, f"HTTP {r.status}", r.status in RETRIABLE_STATUS


def _page(url: str, r: Response | None, attempts: int, error: str | None) -> dict:
    return {"url": url, "final_url": r and r.final_url, "status": r and r.status, "content_type": r and r.content_type, "body": r and r.body, "attempts": attempts, "error": error}


def fetch_one(url: str, fetch: Callable[[str], Response], rules: Politeness, before: Callable[[], None] = lambda: None) -> dict:
    """One URL with its retries; a failure is a row with an error, not an exception. before is called ahead of every request."""
    attempt, error = 0, None
    for attempt in range(1, rules.attempts + 1):
        before()
        r, error, again = _asked(url, fetch)
        if r is not None:
            return _page(url, r, attempt, None)
        if not again:
            break
        if attempt < rules.attempts:
            rules.sleep(rules.backoff_seconds * attempt)
    return _page(url, None, attempt, error)


#: How long a fetched page is held for those after it.
PASSED_ON_SECONDS = 0.5
#: Tasks that fetch at once, at most, where nothing else is said.
MOST_TASKS = 4096


def fetch_pages(urls: DataFrame, fetch: Callable[[str], Response], rules: Politeness | None = None, origins_at_once: int | None = None, robots: DataFrame | None = None, agent: str = "") -> DataFrame:
    """Fetch a column `url`. Requests of one origin are in one task, in turn, so the gap holds for the whole run, retries included. There are as many
    tasks as origins unless origins_at_once says how many. robots: rules as operators.robots.parse gives them; what they forbid the agent is a row with an error and no request."""
    polite = rules or Politeness()
    if robots is not None:
        judged = allowed(urls.select("url"), robots, agent)
        blocked = F.concat(F.lit("Blocked by robots.txt: "), "url")
        no = judged.filter("NOT can_fetch").select("url", *[F.lit(None).cast(t).alias(c) for c, t in (("final_url", "string"), ("status", "int"), ("content_type", "string"), ("body", "string"))], F.lit(0).alias("attempts"), blocked.alias("error"))
        return fetch_pages(judged.filter("can_fetch").select("url"), fetch, polite, origins_at_once).unionByName(no)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = Throttle(polite)
        got, held, since = [], 0, time.monotonic()
        for batch in batches:
            for url, host in zip(batch["url"], batch["__host"]):
                got.append(fetch_one(url, fetch, polite, lambda host=host: gap.wait(host)))
                held += len(got[-1]["body"] or "")
                # pages that come slowly are passed on as they are there, others together
                if time.monotonic() - since > PASSED_ON_SECONDS or len(got) >= 500 or held >= 4 << 20:
                    yield pd.DataFrame(got).astype({"status": "Int32"})
                    got, held, since = [], 0, time.monotonic()
        if got:
            yield pd.DataFrame(got).astype({"status": "Int32"})

    hosts = urls.select("url", F.lower(authority(F.col("url"))).alias("__host"))
    if origins_at_once is None:
        origins_at_once = min(MOST_TASKS, max(1, hosts.agg(F.approx_count_distinct("__host")).first()[0]))
    return hosts.repartition(origins_at_once, "__host").mapInPandas(run, PAGES)


class _Slice(InputPartition):
    def __init__(self, urls: Sequence[str]):
        self.urls = list(urls)


class _Reader(DataSourceReader):
    def __init__(self, urls: str, fetch: Callable[[str], Response], rules: Politeness):
        self._urls, self._fetch, self._rules = [u for u in urls.split("\n") if u], fetch, rules

    def partitions(self):
        by: dict[str, list[str]] = {}
        for u in self._urls:
            by.setdefault(u.split("/", 3)[2] if "://" in u else "", []).append(u)
        return [_Slice(x) for x in by.values()] or [_Slice([])]

    def read(self, partition):
        gap = Throttle(self._rules)
        for u in partition.urls:
            r = fetch_one(u, self._fetch, self._rules, lambda: gap.wait(""))
            yield tuple(r[k] for k in ("url", "final_url", "status", "content_type", "body", "attempts", "error"))


def page_source(name: str, fetch: Callable[[str], Response], rules: Politeness | None = None) -> type[DataSource]:
    """A data source of that name. The class carries its fetch function, so it works in whatever process plans or reads."""
    own_name, own_rules = name, rules or Politeness()

    class PageSource(DataSource):
        @classmethod
        def name(cls):
            return own_name

        def schema(self):
            return PAGES

        def reader(self, schema):
            return _Reader(self.options.get("urls", ""), fetch, own_rules)

    return PageSource


def register(spark: SparkSession, name: str, fetch: Callable[[str], Response], rules: Politeness | None = None) -> None:
    """spark.read.format(name).option("urls", lines).load() fetches with this function from now on, a partition per origin."""
    spark.dataSource.register(page_source(name, fetch, rules))


def looked_up(urls: DataFrame, cache: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """urls with their cache key and the body that the cache (key, body) has for it, null if none. own: columns of both that tell entries of one key apart."""
    known = cache.groupBy("key", *own).agg(F.min("body").alias("body"))
    return urls.withColumn("key", cache_key(F.col("url"))).join(known, ["key", *own], "left")


def through_cache(urls: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], good: Column | None = None, own: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, purged cache): bodies from the cache where they are good (a condition on body; by default, that the page
    doesn't look bad), the rest fetched. cache: (key, body), and the columns `own` that tell several bodies of one URL apart, which fetch gets and gives back as well."""
    kept = cache.filter(good) if good is not None else page_quality(cache, "body").filter("NOT bad_suspect").select("key", *own, "body")
    asked = looked_up(urls.select("url", *own), kept, own)
    miss = fetch(asked.filter("body IS NULL").select("url", *own))
    return asked.filter("body IS NOT NULL").select("url", *own, "body").unionByName(miss.select("url", *own, "body")), kept


def with_fallback(first: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pages (url, body) of a first source; what looks like a challenge comes from the second."""
    judged = page_quality(first.select("url", "body"), "body")
    again = second(judged.filter("challenge_suspect").select("url"))
    return judged.filter("NOT challenge_suspect").select("url", "body").unionByName(again.select("url", "body"))


def toc_pages(urls: DataFrame, fetch: Callable, expand_selector: str | None, expanding: Callable | None = None) -> DataFrame:
    """From the plain source, or from the expanding one where a config wants clicks."""
    if expand_selector is None:
        return fetch(urls)
    if expanding is None:
        raise ValueError("an expand selector needs a source that can click")
    return expanding(urls, expand_selector)
