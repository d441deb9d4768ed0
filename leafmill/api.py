"""Whole runs as functions: crawl, preview, import of books, config generation, validation.

What the command line of such a tool would take are keyword arguments here, and what it would
print are DataFrames. Pages come as a DataFrame (url, html), from a table or from
`sources.pages.fetch_pages`; files go below a root that all executors share.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping
from contextlib import nullcontext
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import BookError, ConfigError, FetchError, ModelError
from .functions.html import chapters_of, css_select, css_select_all, selector_fault, skeleton
from .functions.text import chapter_file, chapter_path, normalize_text, normalize_whitespace, optional, recover_json, slugify
from .functions.selectors import fault
from .functions.urls import authority, origin, urljoin
from .operators.pages import cover_url, selector_issues
from .operators.robots import parse as parse_robots
from .plans import crawl as runs
from .plans import epub, toc
from .session import scratch
from .sources import models, sinks
from .sources.events import EventLog, Follower, Told
from .sources.http import HttpFetcher, robots_files
from .sources.pages import Politeness, Response, fetch_pages

#: From a DataFrame of `url` to one of (url, html).
Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Site:
    """A site by its selectors. `Site.read` takes JSON files, and says what is wrong with one."""

    name: str
    start_url: str
    chapter_link_selector: str
    chapter_content_selector: str
    version: int = 1
    novel_title_selector: str | None = None
    author_selector: str | None = None
    illustration_selector: str | None = None
    toc_next_selector: str | None = None
    toc_expand_selector: str | None = None
    chapter_title_selector: str | None = None
    remove_selectors: tuple[str, ...] = ()
    same_domain: bool = True
    reverse_chapter_order: bool = False
    filter_non_chapter_links: bool = True
    request_delay_seconds: float = 1.0
    timeout_seconds: float = 30.0
    retry_attempts: int = 3
    retry_backoff_seconds: float = 2.0
    max_toc_pages: int = 50
    user_agent: str = "Mozilla/5.0"

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Site:
        from .plans.site_config import typed

        row = typed(spark.read.text(path, wholetext=True)).first().asDict()
        if row["error"]:
            raise ConfigError(row["error"])
        return cls(**{k: tuple(v) if k == "remove_selectors" else v for k, v in row.items() if k in cls.__dataclass_fields__})


def check_selectors(site: Site) -> None:
    """ConfigError for the first of a site's selectors that isn't understood."""
    for key, value in asdict(site).items():
        if "selector" in key:
            for one in value if isinstance(value, tuple) else (value,):
                if wrong := fault(one):
                    raise ConfigError(f"{key}: {wrong}")


def find_config(target: str, configs: str = "configs") -> Path:
    """The file itself, or one of that name in the folder of configs."""
    name = target if target.endswith(".json") else f"{target}.json"
    places = (Path(target), Path(configs, name), Path(configs, target, "config.json"))
    if found := next(filter(Path.is_file, places), None):
        return found
    raise ConfigError(f"no config for {target}: tried {', '.join(str(x) for x in places)}")


@dataclass(frozen=True)
class Settings:
    """Settings of an installation, from a mapping such as the environment."""

    share_dir: str | None = None
    max_chapters: int = 0  # 0: no limit
    provider: str = "ollama"
    temperature: float = 0.0
    max_tokens: int = 4096
    use_browser: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        return cls(
            env.get("NOVEL_SHARE_DIR") or None,
            int(env.get("MAX_CHAPTERS") or 0),
            env.get("LLM_PROVIDER") or "ollama",
            float(env.get("LLM_TEMPERATURE") or 0),
            int(env.get("LLM_MAX_TOKENS") or 4096),
            (env.get("USE_BROWSER") or "").lower() in ("true", "1", "yes"),
        )

    @property
    def share_path(self) -> Path | None:
        return Path(self.share_dir).expanduser() if self.share_dir else None


def _first(page: str, selector: str):
    return F.get(css_select(F.col(page), F.lit(selector)), F.lit(0))


def toc_of(spark: SparkSession, site: Site, pages: DataFrame) -> DataFrame:
    """The site's pages of contents: page_no, url, html."""
    start = spark.createDataFrame([(site.start_url, site.start_url)], "start string, page string")
    if not site.toc_next_selector:
        return pages.filter(F.col("url") == site.start_url).withColumn("page_no", F.lit(1).cast("long"))
    near = pages.filter(authority(F.col("url")) == authority(F.lit(site.start_url))) if site.same_domain else pages
    edges = near.select(F.col("url").alias("page"), _next_page(site).alias("next_page")).filter("next_page IS NOT NULL")
    walked = toc.walk(spark, start, edges, site.max_toc_pages)
    return pages.join(walked.select(F.col("page").alias("url"), "page_no"), "url")


def discover(spark: SparkSession, site: Site, pages: DataFrame) -> DataFrame:
    """Ordered chapter links: position, title, link_url."""
    found = toc_of(spark, site, pages).select("page_no", "url", F.posexplode(css_select(F.col("html"), F.lit(site.chapter_link_selector))).alias("pos", "a"))
    out = found.withColumn("href", F.try_element_at("a.attrs", F.lit("href"))).filter("href <> ''").withColumn("link_url", urljoin(F.col("url"), F.col("href")))
    out = out.withColumn("title", F.coalesce(optional(normalize_text(F.col("a.text"))), "link_url")).withColumn("site", F.lit(site.name))
    if site.same_domain:
        out = out.filter(authority(F.col("link_url")) == authority(F.lit(site.start_url)))
    out = toc.first_wins(out, ["link_url"], ["page_no", "pos"]).withColumn("idx", F.col("page_no") * F.lit(1 << 32) + F.col("pos"))
    if site.filter_non_chapter_links:
        out = toc.likely_chapters(out, ["site"], F.col("title"))
    else:
        out = out.withColumn("chapter_no", toc.chapter_number(F.col("title")))
    return toc.order_chapters(out, ["site"], "idx", site.reverse_chapter_order).select("site", "position", "title", "link_url")


def fetch_toc(spark: SparkSession, site: Site, fetch: Fetch) -> DataFrame:
    """The site's pages of contents (url, html), fetched one after the other along the next-links."""
    url, seen, out = site.start_url, set(), []
    while url and url not in seen and len(out) < max(1, site.max_toc_pages):
        seen.add(url)
        page = fetch(spark.createDataFrame([(url,)], "url string")).select(F.lit(url).alias("url"), "html")
        got = page.withColumn("next_page", _next_page(site) if site.toc_next_selector else F.lit(None).cast("string")).first()
        if got is None or got.html is None:
            raise FetchError(f"page of contents not found: {url}")
        out.append((url, got.html))
        url = got.next_page
    return spark.createDataFrame(out, "url string, html string")


def _next_page(site: Site):
    href = F.try_element_at(_first("html", site.toc_next_selector)["attrs"], F.lit("href"))
    to = urljoin(F.col("url"), href)
    inside = authority(to) == authority(F.lit(site.start_url)) if site.same_domain else F.lit(True)
    return F.when((href != "") & inside, to)


def metadata(spark: SparkSession, site: Site, pages: DataFrame) -> DataFrame:
    """title (the site's name if there is none), author, source_url, illustration_url, site_name."""
    cover_selector = site.illustration_selector
    wanted = [site.novel_title_selector, site.author_selector, cover_selector, f"{cover_selector} img" if cover_selector and "," not in cover_selector else cover_selector]
    page = pages.filter(F.col("url") == site.start_url).withColumn("found", css_select_all(F.col("html"), wanted))
    first = lambda i: F.get(F.get("found", F.lit(i)), F.lit(0))
    text = lambda i: optional(normalize_text(first(i)["text"]))
    node = first(2)
    image = F.when(node["tag"].isin("img", "source", "meta", "link"), node).otherwise(first(3))
    style = F.coalesce(F.try_element_at(node["attrs"], F.lit("style")), F.lit(""))
    cover = F.when(node.isNotNull(), cover_url(F.coalesce(image["attrs"], F.create_map().cast("map<string,string>")), style, F.col("url")))
    return page.select(F.coalesce(text(0), F.lit(site.name)).alias("title"), text(1).alias("author"), F.col("url").alias("source_url"), cover.alias("illustration_url"), F.lit(site.name).alias("site_name"))


@dataclass(frozen=True)
class Run:
    """What came of a crawl: chapters (position, title, url, path, status, error), counters, and where it is."""

    chapters: DataFrame
    counters: dict[str, int]
    root: str


@dataclass(frozen=True)
class Event:
    """One step of a run, as it is told to who asks for progress."""

    current: int
    total: int
    status: str
    title: str
    source_url: str
    path: str | None = None
    error: str | None = None


def crawl(
    spark: SparkSession, site: Site, pages: DataFrame | None, share_root: str, *, fetch: Fetch | None = None, most: int | None = None, overwrite: bool = False, fail_fast: bool = False, progress: Callable[[Event], None] | None = None, at_once: int | None = None
) -> Run:
    """Write a site's chapters, config, metadata and manifest below share_root.

    Chapter pages come from pages (url, html), or from fetch, a function from a DataFrame of `url` to one of (url, html),
    which is asked for nothing that the run does not need; without pages it gets the pages of contents, too. A page without its
    content is fetched again, `retry_attempts` times in all. What exists is not written again unless
    overwritten. `most` counts new chapters: each wave takes as many as are still wanted, so skips
    and failures take none of it. fail_fast goes chapter by chapter and ends at the first failure. The manifest says `running` while the
    run goes on, then `completed`, `failed` or, after an interruption, `interrupted` with what had been written by then. at_once: chapters that a wave has at
    most; with 1 the manifest moves chapter by chapter. progress is told that a chapter is started when its request is, if fetch keeps a log of
    events (`live`), else with its outcome.
    """
    check_selectors(site)
    if pages is None:
        if fetch is None:
            raise ValueError("a crawl needs pages or a fetch function")
        pages = fetch_toc(spark, site, fetch)
    root = f"{share_root}/{spark.range(1).select(slugify(F.lit(site.name)).alias('s')).first().s}"
    # a site's list of links and its one row of metadata, held as plain rows so that what follows has short plans
    found = _plain(discover(spark, site, pages))
    total = found.count()
    if not total:
        raise FetchError("No chapter links found. Check chapter_link_selector.")
    there = [(int(n), p.stat().st_size) for p in Path(root, "input").glob("chapter_*.txt") if (n := p.stem.split("_")[1]).isdigit()]
    rows = runs.resume(found, spark.createDataFrame(there, "position long, n_bytes long"), "position", overwrite)
    rows = rows.withColumn("path", F.concat(F.lit("input/"), chapter_path(F.col("position"))))
    rows, about = _plain(rows), _plain(metadata(spark, site, pages))
    _write_json(root, "config.json", json.dumps(asdict(site), ensure_ascii=False, indent=2))
    sinks.write_named_files(sinks.metadata_json(about).select(F.lit("metadata.json").alias("path"), "content"), root)
    book = _Manifest(spark, site, root, found, about)
    # skipped ones count up to where the run gets
    todo = [r.position for r in rows.filter("NOT skipped").select("position").orderBy("position").toLocalIterator()]
    done: list[DataFrame] = []
    reached, fetched, at = 0, 0, 0
    book.write("running", done)
    begun: set[int] = set()
    following = nullcontext()
    if progress is not None and getattr(fetch, "events", None) is not None:
        of_url = {r.link_url: r for r in rows.filter("NOT skipped").toLocalIterator()}

        def started(event: dict) -> None:
            r = of_url.get(event["url"])
            if event["what"] == "started" and r is not None and r.position not in begun:
                begun.add(r.position)
                progress(Event(r.position, total, "started", r.title, r.link_url, r.path))

        following = Follower(fetch.events, started)
    bad = None
    try:
        with following:
            while bad is None and at < len(todo) and (most is None or fetched < most):
                want = 1 if fail_fast else len(todo) if most is None else most - fetched
                wave = todo[at : at + min(want, at_once or want)]
                at += len(wave)
                tried = _wave(spark, site, rows.filter(F.col("position").between(wave[0], wave[-1]) & ~F.col("skipped")), pages, fetch, root)
                done.append(tried)
                reached = wave[-1]
                fetched += tried.filter("status = 'fetched'").count()
                bad = tried.filter("status = 'failed'").first() if fail_fast else None
                if at < len(todo) and bad is None:
                    book.write("running", done)
    except KeyboardInterrupt:
        done.append(_skips(rows, reached))
        attempted = rows.filter((F.col("position") <= (todo[at - 1] if at else 0)) & ~F.col("skipped"))
        files = [(f"input/{p.name}",) for p in Path(root, "input").glob("chapter_*.txt") if p.stat().st_size]
        recorded = _union(done, rows).select("position")
        late = runs.reconcile(attempted, recorded, attempted.join(spark.createDataFrame(files, "path string"), "path", "left_semi").select("position"), "position")
        done.append(late.select("site", "position", "title", F.col("link_url").alias("url"), "path", F.lit("fetched").alias("status"), F.lit(None).cast("string").alias("error")))
        book.write("interrupted", done)
        raise
    if bad is not None:
        done.append(_skips(rows, reached))
        book.write("failed", done)
        _tell(progress, done, total, begun)
        raise FetchError(f"chapter {bad.position} failed: {bad.error}")
    last = total if at >= len(todo) and (most is None or fetched < most) else reached
    done.append(_skips(rows, last if todo else total))
    counters = book.write("completed", done)
    _tell(progress, done, total, begun)
    return Run(_union(done, rows), counters, root)


def live(spark: SparkSession, site: Site, *, obey_robots: bool = True, fetch: Callable[[str], Response] | None = None, sleep: Callable[[float], None] = time.sleep, events: str | None = None) -> Fetch:
    """A fetch function for `crawl` that asks the site itself: with its delay, timeout, retries and user agent, and within its robots rules.
    Without fetch, over HTTP. A page that can't be had has no html. events: a new folder that executors share, to which tasks write what they are doing."""
    asks = fetch or HttpFetcher(site.user_agent, site.timeout_seconds)
    log = EventLog(events) if events else None
    one = Told(asks, log) if log else asks
    rules = Politeness(max(1, site.retry_attempts), site.retry_backoff_seconds, site.request_delay_seconds, sleep)
    known: dict[str, DataFrame] = {}

    def get(urls: DataFrame) -> DataFrame:
        robots = None
        if obey_robots:
            # the few origins of a site, whose files are asked for once
            for r in urls.select(origin(F.col("url")).alias("o")).filter("o <> ''").distinct().toLocalIterator():
                if r.o not in known:
                    known[r.o] = _plain(robots_files(spark.createDataFrame([(r.o + "/",)], "url string"), asks, 1))
            robots = parse_robots(reduce(DataFrame.unionByName, known.values(), spark.createDataFrame([], "origin string, body string")))
        return fetch_pages(urls, one, rules, robots=robots, agent=site.user_agent).select("url", F.col("body").alias("html"))

    get.events = log
    return get


def crawl_live(spark: SparkSession, site: Site, share_root: str, *, obey_robots: bool = True, **options) -> Run:
    """A crawl of the site itself in one call; options are those of `crawl`."""
    return crawl(spark, site, None, share_root, fetch=live(spark, site, obey_robots=obey_robots, events=scratch(spark, "events")), **options)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _skips(rows: DataFrame, last: int) -> DataFrame:
    return rows.filter(F.col("skipped") & (F.col("position") <= last)).select("site", "position", "title", F.col("link_url").alias("url"), "path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))


def _union(done: list[DataFrame], rows: DataFrame) -> DataFrame:
    out = _skips(rows, 0)
    for x in done:
        out = out.unionByName(x)
    return out


def _wave(spark: SparkSession, site: Site, rows: DataFrame, pages: DataFrame, fetch: Fetch | None, root: str) -> DataFrame:
    """Get, extract and write some chapters: site, position, title, url, path, status, error."""
    own = chapters_of(F.col("html"), site.chapter_content_selector, site.chapter_title_selector, list(site.remove_selectors))
    asked = rows.select("site", "position", "title", F.col("link_url").alias("url"), "path")
    out, rest = None, asked
    for attempt in range(max(1, site.retry_attempts) if fetch else 1):
        have = fetch(rest.select("url").distinct()) if fetch else pages
        got = rest.join(have.select("url", "html"), "url", "left").withColumn("c", own)
        error = F.when(F.col("html").isNull(), "page not found").when(F.col("c.error").isNotNull(), F.col("c.error")).when(F.col("c.body").isNull(), "content node not found").when(F.col("c.body") == "", "content is empty")
        got = got.select("site", "position", F.coalesce(F.when(error.isNull(), F.col("c.title")), "title").alias("title"), "url", "path", error.alias("error"), F.col("c.body").alias("body")).persist(StorageLevel.DISK_ONLY)
        good = got.filter("error IS NULL")
        out = good if out is None else out.unionByName(good)
        rest = asked.join(got.filter("error IS NOT NULL AND error <> 'page not found'").select("position"), "position", "left_semi")
        gone = got.filter("error = 'page not found'")
        out = out.unionByName(gone)
        if not fetch or attempt + 1 == max(1, site.retry_attempts) or not rest.take(1):
            out = out.unionByName(got.filter("error IS NOT NULL AND error <> 'page not found'"))
            break
        time.sleep(site.retry_backoff_seconds * (attempt + 1))
    new = out.filter("error IS NULL").select("path", chapter_file(F.col("title"), F.col("body")).alias("content"))
    sinks.write_named_files(new, root)
    status = F.when(F.col("error").isNull(), "fetched").otherwise("failed")
    return _plain(out.select("site", "position", "title", "url", "path", status.alias("status"), "error"))


def _tell(progress: Callable[[Event], None] | None, done: list[DataFrame], total: int, begun: set[int]) -> None:
    """Every chapter in order: that it was started, if it was and hasn't been told, and what came of it."""
    if progress is None:
        return
    for r in _union(done[1:], done[0].withColumns({"skipped": F.lit(False), "link_url": F.col("url")})).unionByName(done[0]).orderBy("position").toLocalIterator():
        if r.status != "skipped" and r.position not in begun:
            progress(Event(r.position, total, "started", r.title, r.url, r.path))
        progress(Event(r.position, total, r.status, r.title, r.url, None if r.error else r.path, r.error))


def _write_json(root: str, name: str, content: str) -> None:
    # one small document, from the driver
    os.makedirs(root, exist_ok=True)
    part = os.path.join(root, f".{name}.tmp")
    Path(part).write_text(content + "\n", encoding="utf-8")
    os.replace(part, os.path.join(root, name))


class _Manifest:
    """manifest.json of a run, written whole each time."""

    def __init__(self, spark: SparkSession, site: Site, root: str, found: DataFrame, about: DataFrame):
        self._spark, self._site, self._root, self._found, self._about = spark, site, root, found, about
        self._begun = datetime.now(UTC).isoformat()

    def write(self, status: str, done: list[DataFrame]) -> dict[str, int]:
        none = self._found.limit(0).select("site", "position", "title", F.col("link_url").alias("url"), F.lit("").alias("path"), F.lit("").alias("status"), F.lit("").alias("error"))
        out = none
        for x in done:
            out = out.unionByName(x)
        counters = runs.manifest(out, self._found, ["site"]).drop("site").first().asDict()
        lists = runs.manifest_document(out.withColumn("index", F.col("position")), ["site"]).select(F.to_json(F.struct("chapters", "errors"), {"ignoreNullFields": "false"}).alias("j")).first()
        found = self._found.select(F.struct(F.col("position").alias("index"), "title", F.col("link_url").alias("source_url")).alias("c")).agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("j")).first()
        about = json.loads(sinks.metadata_json(self._about).first().content)
        listed = json.loads(lists.j) if lists else {"chapters": [], "errors": []}
        whole = {
            "generated_at": self._begun, "updated_at": datetime.now(UTC).isoformat(), "status": status, "config": asdict(self._site), "metadata": about,
            "runtime_output_dir": self._root, "chapter_output_dir": f"{self._root}/input", **counters, "discovered_chapters": json.loads(found.j), **listed,
        }
        _write_json(self._root, "manifest.json", json.dumps(whole, ensure_ascii=False, indent=2))
        return counters


def preview(spark: SparkSession, site: Site, pages: DataFrame, most: int = 10) -> DataFrame:
    """What a crawl would take first, and how many more there are."""
    return runs.preview(discover(spark, site, pages), ["site"], "position", most)


def validate(spark: SparkSession, site: Site, pages: DataFrame) -> DataFrame:
    """selector_key, selector, matches, ok: on the first page of contents and on the first chapter."""
    chapter = discover(spark, site, pages).orderBy("position").limit(1).select(F.col("link_url").alias("url"))

    def report(page: DataFrame, keys: list[str]) -> DataFrame:
        selectors = [getattr(site, k) for k in keys]
        found = page.select(F.posexplode(css_select_all(F.col("html"), selectors)).alias("i", "m"))
        name = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("i"))
        return found.select(name(keys).alias("selector_key"), name(selectors).alias("selector"), F.size("m").cast("long").alias("matches")).withColumn("matches", F.when(F.col("selector").isNotNull(), F.col("matches")))

    first = report(pages.filter(F.col("url") == site.start_url), ["novel_title_selector", "author_selector", "illustration_selector", "chapter_link_selector", "toc_next_selector"])
    both = first.unionByName(report(pages.join(chapter, "url", "left_semi"), ["chapter_title_selector", "chapter_content_selector"]))
    issues = selector_issues(both).select("selector_key", F.lit(False).alias("ok"))
    return both.join(issues, "selector_key", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))


@dataclass(frozen=True)
class Import:
    """What came of an import: chapters and illustrations in order, warnings, and a summary row per book."""

    chapters: DataFrame
    illustrations: DataFrame
    warnings: DataFrame
    summary: DataFrame


def import_books(spark: SparkSession, path: str, share_root: str, *, name: str | None = None, keep_existing: bool = False) -> Import:
    """Chapters, illustrations and metadata.json of e-books as files below the share root. Unless kept, chapters and
    illustrations that an earlier import of the same name left are taken away first."""
    archives = epub.read_archives(spark, path)
    once = epub.opened(archives)
    chapters, images, warnings = epub.import_books(archives, once)
    stem = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    slug = slugify(F.coalesce(F.lit(name), stem), "epub")
    if not chapters.take(1):
        raise BookError(f"no importable chapters found in {path}")
    titles = epub.book_metadata(once[1])
    text = lambda c: optional(normalize_whitespace(F.col(c)))
    # books whose names give one slug are numbered, by their paths
    named = chapters.select("path").distinct().withColumn("slug", slug)
    place = F.row_number().over(Window.partitionBy("slug").orderBy("path"))
    named = named.withColumn("place", place).select("path", F.when(F.col("place") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("place").cast("string"))).alias("slug"))
    # a number may be another book's own name
    if (twice := named.groupBy("slug").count().filter("count > 1").first()) is not None:
        raise BookError(f"several books would be written to {twice.slug}: give them other names")
    about = named.join(titles, "path", "left")
    about = about.select(
        "path", "slug", F.coalesce(text("title"), F.coalesce(F.lit(name), stem)).alias("title"), text("author").alias("author"), F.col("path").alias("source_url"), F.lit(None).cast("string").alias("illustration_url"), F.col("slug").alias("site_name")
    ).cache()
    if not keep_existing:
        for r in about.select("slug").distinct().toLocalIterator():
            for old in (*Path(share_root, r.slug, "input").glob("chapter_*.txt"), *Path(share_root, r.slug, "illustrations").glob("*-*.*")):
                old.unlink()
    sinks.write_named_files(sinks.metadata_json(about).select(F.concat("slug", F.lit("/metadata.json")).alias("path"), "content"), share_root)
    of_book = about.select("path", "slug")
    files = chapters.join(of_book, "path").select(F.concat("slug", F.lit("/input/"), "file").alias("path"), F.col("text").alias("content"))
    sinks.write_named_files(files, share_root)
    sinks.write_named_files(images.join(of_book, "path").select(F.concat("slug", F.lit("/illustrations/"), "file").alias("path"), F.col("data").alias("content")), share_root)
    n = lambda rows, c: rows.groupBy("path").agg(F.count("*").alias(c))
    summary = about.select("path", "slug", "title", "author").join(n(chapters, "n_chapters"), "path", "left").join(n(images, "n_illustrations"), "path", "left").join(n(warnings, "n_warnings"), "path", "left")
    return Import(chapters, images.orderBy("path", "index"), warnings, summary.na.fill(0, ["n_chapters", "n_illustrations", "n_warnings"]))


TOC_PROMPT = "Give a JSON object with chapter_link_selector, novel_title_selector, author_selector, illustration_selector and toc_next_selector for this page of contents."
CHAPTER_PROMPT = "Give a JSON object with chapter_content_selector, chapter_title_selector and remove_selectors for this chapter page."


def generate(spark: SparkSession, toc_url: str, pages: DataFrame, generate_text: Callable[[str, str], str], name: str) -> dict:
    """A config from a model's answers to the skeletons of two pages; a selector that matches nothing goes back once."""

    def ask(url: str, prompt: str, keys: tuple[str, ...]) -> dict:
        page = pages.filter(F.col("url") == url).select(F.col("url").alias("key"), F.lit(prompt).alias("system"), skeleton(F.col("html")).alias("user"), "html")

        def issues(found: DataFrame) -> DataFrame:
            out = found.join(page.select("key", "html"), "key").withColumn("json", recover_json(F.col("answer")))
            own = lambda k: F.get_json_object("json", f"$.{k}")
            tests = [F.when(F.size(css_select(F.col("html"), own(k))) == 0, F.lit(f"{k} matches 0 elements")) for k in keys]
            tests += [F.concat(F.lit(f"{k}: "), selector_fault(own(k))) for k in keys]
            return out.withColumn("issues", F.array_compact(F.array(F.when(F.col("json").isNull(), "not a JSON object"), *tests))).select("key", "answer", "error", "json", "issues")

        got = models.ask_twice(page, generate_text, issues).first()
        if got is None or got.json is None:
            raise ModelError(f"no usable answer for {url}")
        return json.loads(got.json)

    first = ask(toc_url, TOC_PROMPT, ("chapter_link_selector", "novel_title_selector"))
    draft = Site(name, toc_url, first.get("chapter_link_selector") or "a", "body", filter_non_chapter_links=False)
    chapter = discover(spark, draft, pages).orderBy("position").first()
    second = ask(chapter.link_url, CHAPTER_PROMPT, ("chapter_content_selector", "chapter_title_selector")) if chapter else {}
    remove = second.get("remove_selectors") or ["script", "style"]
    remove = list(dict.fromkeys([*(x for x in ("script", "style") if x not in remove), *remove]))
    own = {k: first.get(k) for k in ("novel_title_selector", "author_selector", "illustration_selector", "toc_next_selector")}
    return {
        "name": name, "start_url": toc_url, "version": 1, **own, "chapter_link_selector": draft.chapter_link_selector, "chapter_content_selector": second.get("chapter_content_selector") or "body",
        "chapter_title_selector": second.get("chapter_title_selector"), "remove_selectors": remove, "max_toc_pages": 50 if own["toc_next_selector"] else 1,
    }


def save_config(config: dict, folder: str) -> str:
    """NAME.json in the folder, whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{config['name']}.json")
    part = f"{path}.tmp"
    Path(part).write_text(json.dumps(config, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)
    return path
