import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import robots
from leafmill.sources import http, models, pages, sinks
from leafmill.streaming import landing


def test_fetch(spark):
    def fetch(url):
        if url.endswith("bad"):
            raise OSError("no route")
        if url.endswith("teapot"):
            return pages.Response(url, 418, "short")
        return pages.Response(url + "/", 200, "body of " + url, "text/html")

    urls = spark.createDataFrame([(f"http://h{i % 2}/{x}",) for i, x in enumerate(("a", "bad", "c", "teapot"))], "url string")
    rules = pages.Politeness(attempts=2, backoff_seconds=0, delay_seconds=0)
    got = {r.url: r for r in pages.fetch_pages(urls, fetch, rules).collect()}
    assert got["http://h0/a"].body == "body of http://h0/a" and got["http://h0/a"].attempts == 1
    assert (got["http://h1/bad"].error, got["http://h1/bad"].attempts) == ("no route", 2)
    assert (got["http://h1/teapot"].error, got["http://h1/teapot"].attempts) == ("HTTP 418", 1)


def test_retry_waits():
    waits, tries = [], []

    def fetch(url):
        tries.append(url)
        return pages.Response(url, 503 if len(tries) < 3 else 200, "x")

    got = pages.fetch_one("u", fetch, pages.Politeness(3, 2.0, 0, waits.append))
    assert (got["attempts"], waits) == (3, [2.0, 4.0])


def test_cache(spark):
    from leafmill.functions.text import cache_key

    good = "<p>" + "fine words " * 40
    urls = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://a/3",)], "url string")
    cache = urls.select(cache_key(F.col("url")).alias("key"), F.when(F.col("url").endswith("1"), good).otherwise("tiny").alias("body")).limit(2)
    out, kept = pages.through_cache(urls, cache, lambda miss: miss.withColumn("body", F.lit("new")))
    assert {r.url: r.body for r in out.collect()} == {"http://a/1": good, "http://a/2": "new", "http://a/3": "new"}
    assert kept.count() == 1
    assert sinks.cache_put(kept, kept.withColumn("body", F.lit("x"))).first().body == "x"
    assert sinks.cache_drop(kept, kept).count() == 0


def test_models(spark):
    rows = spark.createDataFrame([("a", "s", "first"), ("b", "s", "ok")], "key string, system string, user string")
    judge = lambda df: df.withColumn("issues", F.when(F.col("answer") == "first", F.array(F.lit("no"))).otherwise(F.array().cast("array<string>")))
    got = {r.key: r.answer for r in models.ask_twice(rows, lambda s, u: u, judge).collect()}
    assert got == {"a": "first\nFix: no", "b": "ok"}
    known = spark.createDataFrame([("a", "known")], "key string, answer string")
    assert {r.key: r.answer for r in models.known_first(rows, known, lambda s, u: u).collect()} == {"a": "known", "b": "ok"}
    waits = []

    def fail(s, u):
        raise RuntimeError("HTTP 503")

    assert models.call(fail, "", "", waits.append) == (None, "HTTP 503") and waits == [5.0, 10.0, 20.0]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("n/input/chapter_1.txt", "é\n"), ("n/input/chapter_2.txt", "b")], "path string, content string")
    sinks.write_named_files(rows, str(tmp_path))
    assert (tmp_path / "n/input/chapter_1.txt").read_text() == "é\n"
    assert len(list((tmp_path / "n/input").iterdir())) == 2


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/3.txt").write_text("old")
    rows = spark.range(40).select(F.format_string("n/%d.txt", "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("torn"))).otherwise(F.col("id").cast("string")).alias("content")).repartition(8)
    with pytest.raises(Exception, match="torn"):
        sinks.write_named_files(rows, str(tmp_path))
    with pytest.raises(Exception, match="outside"):
        sinks.write_named_files(spark.createDataFrame([("n/1.txt", "x"), ("../up.txt", "y")], "path string, content string").coalesce(1), str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*")] == ["n", "3.txt"] and (tmp_path / "n/3.txt").read_text() == "old"
    sinks.write_named_files(rows.filter("path <> 'n/37.txt'").withColumn("content", F.col("path")), str(tmp_path))
    assert len(list((tmp_path / "n").iterdir())) == 39 and (tmp_path / "n/3.txt").read_text() == "n/3.txt" and [p.name for p in tmp_path.iterdir()] == ["n"]
    sinks.write_named_files(rows.limit(0), str(tmp_path))


def test_an_attempt_that_is_not_committed_writes_nothing(tmp_path):
    """What speculation leaves: two attempts of one task, of which one is committed."""
    from pyspark.sql import Row

    job = sinks._FileWriter(str(tmp_path))
    job.write(iter([Row(path="a.txt", content=b"lost")]))
    kept = job.write(iter([Row(path="a.txt", content=b"kept"), Row(path="b/c.txt", content=b"")]))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == []
    job.commit([kept, None])
    assert (tmp_path / "a.txt").read_bytes() == b"kept" and (tmp_path / "b/c.txt").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 2


def test_metadata_json(spark):
    df = spark.createDataFrame([("T", None, "u", None, "s")], "title string, author string, source_url string, illustration_url string, site_name string")
    got = json.loads(sinks.metadata_json(df).first().content)
    assert list(got) == ["title", "translated", "author", "source_url", "illustration_url", "site_name"] and got["translated"] == {"en": None, "vi": None}


def test_stream_is_batch(spark, tmp_path):
    page = "<h1>C</h1><article><p>text {}</p></article>"
    rows = [(i, f"http://a/{i % 6}", page.format(i)) for i in range(9)] + [(20, "http://a/20", "<p>nothing")]
    df = spark.createDataFrame(rows, landing.PAGES)
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    seen = []
    df.filter("page_id < 5").coalesce(1).write.mode("append").parquet(land)
    landing.run(spark, land, out, check, on_batch=lambda n, m: seen.append(m.first().completed_chapters)).awaitTermination()
    df.filter("page_id >= 5").coalesce(1).write.mode("append").parquet(land)
    landing.run(spark, land, out, check, on_batch=lambda n, m: seen.append(m.first().completed_chapters)).awaitTermination()
    landing.run(spark, land, out, check).awaitTermination()  # nothing new
    assert seen == [5, 7]
    got = {(r.url, r.page_id) for r in spark.read.parquet(out).collect()}
    assert got == {(f"http://a/{i}", i) for i in range(6)} | {("http://a/20", 20)}
    assert tuple(landing.snapshot(spark, out).first()) == (7, 6, 1)


def test_quota_over_runs(spark, tmp_path):
    page = "<h1>C</h1><article><p>t</p></article>"
    df = spark.createDataFrame([(i, f"http://a/{i}", page) for i in range(6)], landing.PAGES)
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    df.filter("page_id < 3").coalesce(1).write.parquet(land)
    landing.run(spark, land, out, check, most=4).awaitTermination()
    df.filter("page_id >= 3").coalesce(1).write.mode("append").parquet(land)
    landing.run(spark, land, out, check, most=4).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.page_id for r in rows.filter("status = 'fetched'").collect()) == [0, 1, 2, 3]
    assert sorted(r.page_id for r in rows.filter("status = 'pending'").collect()) == [4, 5]  # they wait, and are not lost


def test_failures_take_no_quota(spark, tmp_path):
    good = "<h1>C</h1><article><p>t</p></article>"
    pages = [(0, "http://a/0", "<p>nothing")] + [(i, f"http://a/{i}", good) for i in (1, 2, 3)]
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    spark.createDataFrame(pages, landing.PAGES).coalesce(1).write.parquet(land)
    landing.run(spark, land, out, check, most=2).awaitTermination()
    assert tuple(landing.snapshot(spark, out).first()) == (3, 2, 1)
    landing.run(spark, land, out, check, most=10).awaitTermination()
    assert tuple(landing.snapshot(spark, out).first()) == (4, 3, 1)
    # a URL that failed is tried anew when it comes again
    spark.createDataFrame([(9, "http://a/0", good)], landing.PAGES).coalesce(1).write.mode("append").parquet(land)
    landing.run(spark, land, out, check, most=10).awaitTermination()
    assert tuple(landing.snapshot(spark, out).first()) == (4, 4, 0)
    assert {r.url for r in landing.latest(spark.read.parquet(out)).filter("status = 'fetched'").collect()} == {u for _, u, _ in pages}


def test_page_source(spark):
    pages.register(spark, "leafmill_test_pages", lambda url: pages.Response(url + "#", 200, "body of " + url), pages.Politeness(delay_seconds=0))
    got = spark.read.format("leafmill_test_pages").option("urls", "http://a/1\nhttp://b/2\nhttp://a/3").load()
    assert {r.url: r.body for r in got.collect()} == {f"http://{x}": f"body of http://{x}" for x in ("a/1", "b/2", "a/3")}
    assert spark.read.format("leafmill_test_pages").load().count() == 0


def test_robots_go_before_requests(spark):
    urls = spark.createDataFrame([("http://a/p/1",), ("http://a/q",)], "url string")
    rules = robots.parse(spark.createDataFrame([("http://a", "User-agent: *\nDisallow: /p")], "origin string, body string"))

    def fetch(url):
        assert "/p" not in url
        return pages.Response(url, 200, "x")

    got = {r.url: r for r in pages.fetch_pages(urls, fetch, pages.Politeness(1, 0, 0), robots=rules, agent="leafmill").collect()}
    assert got["http://a/q"].body == "x" and got["http://a/p/1"].error == "Blocked by robots.txt: http://a/p/1" and got["http://a/p/1"].attempts == 0


class _Site(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, dict(self.headers)))
        body = {"/robots.txt": b"User-agent: *\nDisallow: /no"}.get(self.path, "<p>\xe9".encode("latin-1"))
        self.send_response(503 if self.path == "/busy" else 200)
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.send_header("Set-Cookie", "k=v")
        self.send_header("Content-Encoding", "gzip")
        self.end_headers()
        self.wfile.write(gzip.compress(body))

    def log_message(self, *args):
        pass


def test_http_fetcher(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root, fetch = f"http://127.0.0.1:{server.server_port}", http.HttpFetcher("leafmill/1")
        first, second, busy = fetch(f"{root}/1"), fetch(f"{root}/2"), fetch(f"{root}/busy")
        assert (first.status, first.body, busy.status) == (200, "<p>é", 503)
        (_, a), (_, b), _ = _Site.seen
        assert a["User-Agent"] == "leafmill/1" and "Referer" not in a and b["Referer"] == f"{root}/1" and b["Cookie"] == "k=v" and b["Host"] == f"127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{root}/{x}",) for x in ("a", "no/b")], "url string")
        rules = robots.parse(http.robots_files(urls, fetch))
        got = {r.url: r for r in pages.fetch_pages(urls, fetch, pages.Politeness(1, 0, 0), robots=rules, agent="leafmill/1").collect()}
        assert got[f"{root}/a"].body == "<p>é" and got[f"{root}/no/b"].attempts == 0
    finally:
        server.shutdown()


def test_pages_that_come_fast_are_passed_on_together(spark, monkeypatch):
    """A frame per page costs more than the page."""
    monkeypatch.setattr(pages, "PASSED_ON_SECONDS", 60)
    run = []
    urls = spark.createDataFrame([(f"https://h.example/{i}",) for i in range(700)], "url string").coalesce(1)
    monkeypatch.setattr(type(urls), "mapInPandas", lambda self, f, schema: run.append(f) or self)
    pages.fetch_pages(urls, lambda u: pages.Response(u, 200, "x"), pages.Politeness(1, 0, 0))
    frames = list(run[0](iter([pd.DataFrame({"url": [f"https://h.example/{i}" for i in range(700)], "__host": "h.example"})])))
    assert [len(x) for x in frames] == [500, 200] and list(frames[1]["url"])[-1] == "https://h.example/699"
