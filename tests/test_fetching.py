"""Fetching: the gap between requests, whatever fails, and a live crawl of a site on this machine."""

import json
import threading
import time
from http.client import IncompleteRead, InvalidURL
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from leafmill import api
from leafmill.errors import ConfigError
from leafmill.sources import http, pages


class Clock:
    def __init__(self):
        self.now, self.starts = 0.0, []

    def sleep(self, s):
        self.now += s

    def fetch(self, url):
        self.starts.append((self.now, url))
        self.now += 0.1
        return pages.Response(url, 503 if "bad" in url else 200, "x" * 600 if "ok" in url else "")


def test_no_two_starts_are_closer_than_the_gap():
    clock = Clock()
    rules = pages.Politeness(3, 0.05, 0.3, clock.sleep, lambda: clock.now)
    gap = pages.Throttle(rules)
    got = [pages.fetch_one(u, clock.fetch, rules, lambda: gap.wait("h")) for u in ("bad/1", "ok/2", "bad/3", "ok/4")]
    assert [(r["attempts"], r["error"]) for r in got] == [(3, "HTTP 503"), (1, None)] * 2 and len(clock.starts) == 8
    starts = [t for t, _ in clock.starts]
    assert min(b - a for a, b in zip(starts, starts[1:])) >= 0.3 - 1e-9 and starts[-1] < 2.6
    # another origin's requests don't wait for this one's
    before = clock.now
    gap.wait("other")
    assert clock.now == before


def test_whatever_a_fetch_raises_is_the_rows_error(spark):
    raised = {"timeout": TimeoutError("late"), "cut": IncompleteRead(b"x"), "odd": InvalidURL("no"), "letter": UnicodeEncodeError("ascii", "é", 0, 1, "x"), "value": ValueError("unknown url type"), "key": KeyError("k")}

    def fetch(url):
        raise raised[url]

    assert {u: pages.fetch_one(u, fetch, pages.Politeness(2, 0, 0))["attempts"] for u in raised} == {"timeout": 2, "cut": 2, "odd": 1, "letter": 1, "value": 1, "key": 1}
    urls = spark.createDataFrame([(u,) for u in ("foo", "http://127.0.0.1:9/a b", "http://", "ftp://h/x", "http://h\x00/", "http://[::1", "", None)], "url string")
    got = pages.fetch_pages(urls, http.HttpFetcher("a", 2), pages.Politeness(1, 0, 0)).collect()
    assert len(got) == 8 and all(r.error and r.body is None for r in got)


def test_urls_as_they_are_sent():
    assert http.asked_for(" http://h.example/a b/é?q=ü x%20y#f") == "http://h.example/a%20b/%C3%A9?q=%C3%BC%20x%20y"
    assert http.asked_for("https://bücher.example:81/") == "https://xn--bcher-kva.example:81/"


SITE = {
    "/robots.txt": "User-agent: *\nDisallow: /c/3",
    "/toc": "<h1>Book</h1><nav><a href='/c/1'>Chapter 1</a><a href='/c/2 b'>Chapter 2</a><a href='/c/3'>Chapter 3</a><a href='/c/4'>Chapter 4</a></nav>",
    "/c/1": "<h1>Chapter 1</h1><article><p>One</p></article>",
    "/c/2%20b": "<h1>Chapter 2</h1><article><p>Two</p></article>",
    "/c/3": "<article>secret</article>",
}


@pytest.fixture
def site():
    starts, failed = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            starts.append((time.monotonic(), self.path, dict(self.headers)))
            status = 200 if self.path in SITE else 404
            if self.path == "/c/1" and not failed:  # the first attempt fails
                failed.append(1)
                status = 503
            body = SITE.get(self.path, "").encode() if status == 200 else b""
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", starts
    server.shutdown()


def test_a_live_crawl(spark, tmp_path, site):
    root, starts = site
    own = api.Site("Live Book", f"{root}/toc", "nav a", "article", chapter_title_selector="h1", request_delay_seconds=0.6, retry_attempts=2, retry_backoff_seconds=0, user_agent="mill/1 (test)", filter_non_chapter_links=False)
    told, seen = [], []

    def progress(event):
        told.append((time.monotonic(), event.current, event.status))
        path = next(Path(tmp_path).rglob("manifest.json"), None)
        seen.append(len(json.loads(path.read_text())["chapters"]) if path else 0)

    run = api.crawl_live(spark, own, str(tmp_path), progress=progress, at_once=1)
    assert {r.position: (r.status, r.error) for r in run.chapters.collect()} == {1: ("fetched", None), 2: ("fetched", None), 3: ("failed", "page not found"), 4: ("failed", "page not found")}
    assert Path(run.root, "input/chapter_2.txt").read_text().split() == ["Chapter", "2", "Two"]
    asked = [p for _, p, _ in starts]
    assert "/c/3" not in asked and asked.count("/c/1") == 2 and asked.count("/robots.txt") == 1
    assert all(h["User-Agent"] == "mill/1 (test)" and h["Sec-Fetch-User"] == "?1" for _, _, h in starts)
    times = [t for t, p, _ in starts if p.startswith("/c/")]
    assert min(b - a for a, b in zip(times, times[1:])) > 0.35  # as they arrive
    # each chapter is told as started once, when its request is and before the last one's is made; the manifest grows in between
    begun = {p: t for t, p, what in told if what == "started"}
    assert sorted(begun) == [1, 2, 3, 4] or sorted(begun) == [1, 2, 4], told
    assert len([1 for _, _, what in told if what == "started"]) == len(begun) and begun[1] < max(t for t, p, _ in starts if p == "/c/4")
    assert sorted(set(seen)) == [0, 1, 2] and sorted(p for _, p, what in told if what != "started") == [1, 2, 3, 4]
    assert json.loads(Path(run.root, "manifest.json").read_text())["status"] == "completed"


def test_a_site_with_a_bad_selector_is_not_asked(spark, tmp_path):
    for key in ("chapter_link_selector", "remove_selectors"):
        bad = {"chapter_link_selector": "a", "chapter_content_selector": "p"} | {key: "a:nth-child(" if key != "remove_selectors" else ("p", "..x")}
        with pytest.raises(ConfigError, match=f"{key}: selector not understood"):
            api.crawl(spark, api.Site("s", "http://x/", **bad), spark.createDataFrame([], "url string, html string"), str(tmp_path))


def test_events_are_told_once_and_in_time(tmp_path):
    from leafmill.sources.events import EventLog, Follower

    got = []
    log, other = EventLog(str(tmp_path / "e")), EventLog(str(tmp_path / "e"))
    with Follower(log, got.append, 0.02):
        for i in range(20):
            (log if i % 2 else other).append(what="x", n=i)
        end = time.time() + 10
        while len(got) < 20 and time.time() < end:
            time.sleep(0.01)
        early = len(got)
        log.append(what="last", n=20)
    assert early == 20 and sorted(e["n"] for e in got) == list(range(21))

    def fails(event):
        raise RuntimeError("told badly")

    with pytest.raises(RuntimeError, match="told badly"), Follower(log, fails, 0.02):
        pass
