import json

import pytest
from pyspark.sql import functions as F

from leafmill import api
from leafmill.errors import FetchError
from leafmill.functions.html import chapter_of

SITE = api.Site("My Café", "http://s.example/toc", "nav a", "article.content", novel_title_selector="h1", author_selector=".by", illustration_selector=".cover", toc_next_selector="a.next", chapter_title_selector="h1", remove_selectors=("p.ads",))
PAGES = [
    ("http://s.example/toc", "<h1> Title </h1><p class=by>A</p><div class=cover style=\"background:url('/c.png')\"></div><nav><a href=/2>Chapter 2</a><a href=/n>Notice</a></nav><a class=next href=toc2>n</a>"),
    ("http://s.example/toc2", "<nav><a href=/1>Chapter 1</a><a href=/2>Chapter 2 again</a><a href=/3>Chapter 3</a></nav><a class=next href=/toc>n</a>"),
    ("http://s.example/1", "<h1>One</h1><article class=content><p>x <i>y</i></p><p class=ads>buy</p><p>z</p></article>"),
    ("http://s.example/2", "<h1>Two</h1><article class=content><p>two</p></article>"),
    ("http://s.example/3", "<h1>Three</h1>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "url string, html string")


def test_crawl(spark, pages, tmp_path):
    got = [(r.position, r.title) for r in api.discover(spark, SITE, pages).orderBy("position").collect()]
    assert got == [(1, "Chapter 1"), (2, "Chapter 2"), (3, "Chapter 3")]
    first = api.crawl(spark, SITE, pages, str(tmp_path), most=1)
    assert first.counters == {"total_chapters": 3, "completed_chapters": 1, "fetched_chapters": 1, "skipped_chapters": 0, "failed_chapters": 0}
    root = tmp_path / "my-cafe"
    assert (root / "input/chapter_1.txt").read_text() == "One\n\nx\ny\nz\n"
    second = api.crawl(spark, SITE, pages, str(tmp_path))
    assert second.counters == {"total_chapters": 3, "completed_chapters": 3, "fetched_chapters": 1, "skipped_chapters": 1, "failed_chapters": 1}
    meta = json.loads((root / "metadata.json").read_text())
    assert (meta["title"], meta["author"], meta["illustration_url"], meta["site_name"]) == ("Title", "A", "http://s.example/c.png", "My Café")
    manifest = json.loads((root / "manifest.json").read_text())
    assert [e["error"] for e in manifest["errors"]] == ["content node not found"] and len(manifest["chapters"]) == 2
    with pytest.raises(RuntimeError):
        api.crawl(spark, SITE, pages, str(tmp_path), fail_fast=True)
    assert [r.more for r in api.preview(spark, SITE, pages, 2).collect()] == [1, 1]


def served(answers, asked):
    """A fetch function over lists of answers; each URL's next answer, the last one for good."""

    def fetch(urls):
        rows = []
        for r in urls.orderBy("url").collect():
            asked.append(r.url)
            mine = answers.get(r.url)
            rows.append((r.url, mine.pop(0) if mine and len(mine) > 1 else mine[0] if mine else None))
        return urls.sparkSession.createDataFrame(rows, "url string, html string")

    return fetch


def site_with(chapters, **more):
    toc = "<h1>B</h1><nav>" + "".join(f"<a href=/{i}>Chapter {i}</a>" for i in range(1, chapters + 1)) + "</nav>"
    return api.Site("b", "http://s.example/t", "nav a", "article", retry_backoff_seconds=0.0, **more), {"http://s.example/t": [toc]}


GOOD = "<article>text</article>"


def test_run_fetches_no_more_than_it_needs(spark, tmp_path):
    site, answers = site_with(3)
    answers |= {"http://s.example/1": ["<p>no"], "http://s.example/2": [GOOD], "http://s.example/3": [GOOD]}
    asked, events = [], []
    run = api.crawl(spark, site, None, str(tmp_path), fetch=served(answers, asked), most=1, progress=events.append)
    # chapter 1 fails after three tries and takes no quota, chapter 2 fills it, chapter 3 is left alone
    assert asked == ["http://s.example/t", *["http://s.example/1"] * 3, "http://s.example/2"]
    assert run.counters == {"total_chapters": 3, "completed_chapters": 2, "fetched_chapters": 1, "skipped_chapters": 0, "failed_chapters": 1}
    assert [(e.current, e.status) for e in events] == [(1, "started"), (1, "failed"), (2, "started"), (2, "fetched")]
    manifest = json.loads((tmp_path / "b/manifest.json").read_text())
    assert manifest["status"] == "completed" and manifest["config"]["start_url"] == site.start_url and manifest["metadata"]["title"] == "b"
    assert [c["source_url"] for c in manifest["discovered_chapters"]] == [f"http://s.example/{i}" for i in (1, 2, 3)] and manifest["generated_at"] <= manifest["updated_at"]
    assert json.loads((tmp_path / "b/config.json").read_text())["chapter_content_selector"] == "article"
    # the next run skips what is there
    asked.clear()
    answers["http://s.example/1"] = ["<p>no", GOOD]  # a page that is whole the second time
    again = api.crawl(spark, site, None, str(tmp_path), fetch=served(answers, asked))
    assert sorted(asked[1:]) == ["http://s.example/1", "http://s.example/1", "http://s.example/3"]
    assert (again.counters["fetched_chapters"], again.counters["skipped_chapters"], again.counters["failed_chapters"]) == (2, 1, 0)


def test_fail_fast_keeps_what_came_before(spark, tmp_path):
    site, answers = site_with(3, retry_attempts=1)
    answers |= {"http://s.example/1": [GOOD], "http://s.example/2": ["<p>no"], "http://s.example/3": [GOOD]}
    asked = []
    with pytest.raises(FetchError):
        api.crawl(spark, site, None, str(tmp_path), fetch=served(answers, asked), fail_fast=True)
    assert asked[1:] == ["http://s.example/1", "http://s.example/2"]
    manifest = json.loads((tmp_path / "b/manifest.json").read_text())
    assert (manifest["status"], manifest["fetched_chapters"], manifest["failed_chapters"]) == ("failed", 1, 1)
    assert (tmp_path / "b/input/chapter_1.txt").exists() and not (tmp_path / "b/input/chapter_3.txt").exists()


def test_interruption_records_what_was_written(spark, tmp_path):
    site, answers = site_with(3, retry_attempts=1)
    fetch = served(answers, [])

    def stopped(urls):
        if urls.filter("url LIKE '%/t'").count():
            return fetch(urls)
        (tmp_path / "b/input").mkdir(parents=True)
        (tmp_path / "b/input/chapter_2.txt").write_text("written before the interruption")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        api.crawl(spark, site, None, str(tmp_path), fetch=stopped)
    manifest = json.loads((tmp_path / "b/manifest.json").read_text())
    assert (manifest["status"], manifest["fetched_chapters"]) == ("interrupted", 1) and [c["index"] for c in manifest["chapters"]] == [2]


def test_import_of_books(spark, tmp_path):
    from tests.test_plans import CONTAINER, OPF, book

    parts = {"META-INF/container.xml": CONTAINER, "O/c.opf": OPF, "O/T/1.xhtml": "<h1>Chapter 4</h1><p>x</p><img src='../I/a.png'/>", "O/T/2.xhtml": "<h1>Chapter 7</h1><p>z</p>", "O/I/a.png": b"1", "O/nav.xhtml": "<p>contents</p>"}
    (tmp_path / "One.epub").write_bytes(book(parts))
    share = tmp_path / "share"
    for old in ("one/input/chapter_9.txt", "one/input/notes.txt", "one/illustrations/009-001.png"):
        (share / old).parent.mkdir(parents=True, exist_ok=True)
        (share / old).write_text("old")
    got = api.import_books(spark, str(tmp_path / "One.epub"), str(share))
    assert [r.number for r in got.chapters.collect()] == [4, 7] and [r.file for r in got.illustrations.collect()] == ["004-001.png"]
    assert sorted(p.name for p in (share / "one/input").iterdir()) == ["chapter_4.txt", "chapter_7.txt", "notes.txt"] and [p.name for p in (share / "one/illustrations").iterdir()] == ["004-001.png"]
    meta = json.loads((share / "one/metadata.json").read_text())
    assert (meta["title"], meta["author"], meta["site_name"]) == ("Book", "Me", "one")
    summary = got.summary.first()
    assert (summary.slug, summary.n_chapters, summary.n_illustrations, summary.n_warnings) == ("one", 2, 1, 1)
    (share / "one/input/chapter_9.txt").write_text("old")
    api.import_books(spark, str(tmp_path / "One.epub"), str(share), keep_existing=True)
    assert (share / "one/input/chapter_9.txt").exists()


def test_validate(spark, pages):
    got = {r.selector_key: (r.matches, r.ok) for r in api.validate(spark, SITE, pages).collect()}
    assert got["chapter_link_selector"] == (2, True) and got["chapter_content_selector"] == (1, True)
    bad = api.Site("x", SITE.start_url, "nav a", "main")
    assert not {r.selector_key: r.ok for r in api.validate(spark, bad, pages).collect()}["chapter_content_selector"]


def test_generate(spark, pages, tmp_path):
    def model(system, user):
        if "page of contents" in system:
            return '```json\n{"chapter_link_selector": "nav a", "novel_title_selector": "h1", "toc_next_selector": null}\n```'
        return '{"chapter_content_selector": "article", "chapter_title_selector": "h1", "remove_selectors": ["p.ads"]}' if "Fix:" in user else '{"chapter_content_selector": "main"}'

    config = api.generate(spark, SITE.start_url, pages, model, "s")
    assert (config["chapter_content_selector"], config["remove_selectors"], config["max_toc_pages"]) == ("article", ["script", "style", "p.ads"], 1)
    site = api.Site.read(spark, api.save_config(config, str(tmp_path)))
    assert site.chapter_link_selector == "nav a" and site.remove_selectors == ("script", "style", "p.ads")
    assert api.find_config("s", str(tmp_path)).name == "s.json"
    with pytest.raises(ValueError):
        api.find_config("t", str(tmp_path))


def test_settings():
    assert api.Settings.of({}) == api.Settings()
    got = api.Settings.of({"MAX_CHAPTERS": "3", "USE_BROWSER": "Yes", "NOVEL_SHARE_DIR": "/s"})
    assert (got.max_chapters, got.use_browser, str(got.share_path)) == (3, True, "/s")


def test_nested_removal():
    page = "<div id=c>a<div class=x>b<div class=x>c</div></div>d<br>e<script>f</script></div>"
    assert chapter_of(page, "#c", None, [".x"]) == (None, "ad\ne", None)
    assert chapter_of(page, "#none", "h1", []) == (None, None, None)


def test_unused_pages_do_no_harm(spark, pages):
    more = pages.withColumn("extra", F.lit(1)).unionByName(spark.createDataFrame([("http://o.example/", None, 2)], "url string, html string, extra int"))
    assert api.discover(spark, SITE, more.drop("extra")).count() == 3


def test_books_of_one_name_do_not_overwrite_each_other(spark, tmp_path):
    import io
    import zipfile

    def book(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfile full-path="c.opf"/></container>')
            z.writestr("c.opf", '<package><metadata/><manifest><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
            z.writestr("1.xhtml", f"<h1>Chapter 1</h1>{text}")
        return out.getvalue()

    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "Same Book.epub").write_bytes(book(folder))
    got = api.import_books(spark, str(tmp_path / "in/*"), str(tmp_path / "out"))
    assert sorted(r.slug for r in got.summary.collect()) == ["same-book", "same-book-2"]
    assert [(tmp_path / "out" / s / "input/chapter_1.txt").read_text().split()[-1] for s in ("same-book", "same-book-2")] == ["a", "b"]
