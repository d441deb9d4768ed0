"""The segmented cache and rendered pages, with fake sessions."""

import random
from pathlib import Path

import pytest

from leafmill.sources import pages, rendered
from leafmill.sources.cache import SegmentedCache

KEYED = "key string, body string"


def test_cache_against_a_dict(spark, tmp_path):
    rng = random.Random(1)
    cache, model = SegmentedCache(spark, str(tmp_path / "c"), buckets=4), {}
    assert cache.read().collect() == [] and cache.compact() == 0
    for step in range(5):
        keys = [f"k{rng.randrange(12)}" for _ in range(6)]
        if step == 3:
            cache.drop(spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string"))
            for k in keys:
                model.pop(k, None)
        else:
            rows = [(k, f"{step}-{k}") for k in keys] + [(None, "x")] + ([("k1", None)] if step == 2 else [])
            if step == 2:
                rows = [r for r in rows if r[0] != "k1" or r[1] is None]
            before = {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
            cache.put(spark.createDataFrame(rows, KEYED))
            # what was there is not touched
            assert all(p.stat().st_mtime_ns == t for p, t in before.items())
            for k, b in rows:
                if k is not None:
                    model[k] = b
                    if b is None:
                        del model[k]
        assert {r.key: r.body for r in cache.read().collect()} == model
    # an unfinished segment is none
    (tmp_path / "c/v=000000000099-torn").mkdir()
    assert cache.compact() == 5 and len(cache.segments()) == 1 and {r.key: r.body for r in cache.read().collect()} == model
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("none",), (None,)], "key string")
    assert {r.key: r.body for r in cache.lookup(asked).collect()} == {k: v for k, v in model.items() if k in ("k1", "k2")}
    cache.put(spark.createDataFrame([("k2", "new"), ("k2", "newer")], KEYED))
    assert cache.lookup(asked).filter("key = 'k2'").first().body == "newer"


def sessions_of(log):
    """A function that opens fake sessions; its classes go to the workers with it."""

    class FakePage:
        def __init__(self, log, stays):
            self.log, self.stays, self.at, self.links = log, stays, "", 2

        def goto(self, url):
            self._say("goto " + url)
            self.at = url
            return 404 if "gone" in url else None if "mute" in url else 200

        def _say(self, what):
            with open(self.log, "a") as f:
                f.write(what + "\n")

        def count(self, selector):
            return self.links if selector == ".list a" else 1 if selector == "text=More" and (self.links < 6 or "endless" in self.at) and "bare" not in self.at else 0

        def click(self, selector):
            self._say("click")
            if "stuck" in self.at:
                raise RuntimeError("covered")

        def grown(self, selector, before, seconds):
            self.links = before + 2 if "endless" not in self.at or before < 40 else before

        def content(self):
            return "x" * 20 + f"<i>{self.links}</i>"

        def url(self):
            return self.at + "/"

        def close(self):
            self._say("close page")

    class FakeSession:
        def __init__(self, log):
            self.log, self.pages = log, 0
            with open(log, "a") as f:
                f.write("open\n")

        def new_page(self):
            self.pages += 1
            if self.pages == 4:
                raise RuntimeError("the browser is gone")
            return FakePage(self.log, True)

        def close(self):
            with open(self.log, "a") as f:
                f.write("close\n")

    return lambda: FakeSession(log)


def test_rendered_pages(spark, tmp_path):
    log = str(tmp_path / "log")
    names = ("plain", "bare", "stuck", "endless", "gone", "mute")
    urls = spark.createDataFrame([(f"http://h/{n}",) for n in names], "url string")
    source = rendered.expanding_source(sessions_of(log), ".list a", pages.Politeness(2, 0, 0), sessions=1)
    got = {r.url.rsplit("/", 1)[1]: r for r in pages.toc_pages(urls, None, "text=More", source).collect()}
    assert got["plain"].body.endswith("<i>6</i>") and got["plain"].final_url == "http://h/plain/" and got["endless"].body.endswith("<i>40</i>")
    assert got["bare"].error.endswith("Expand selector did not match: text=More") and got["stuck"].error.endswith("Could not click expand selector text=More: covered")
    assert got["bare"].attempts == got["stuck"].attempts == 1
    assert got["gone"].error == "ClickError: Expand selector did not match: text=More" or got["gone"].error == "HTTP 404"
    assert got["mute"].error == "Browser error while fetching http://h/mute: No response from page: http://h/mute" and got["mute"].attempts == 2
    said = Path(log).read_text().split("\n")
    # one session, opened anew when it died; every page is closed, and so is every session
    assert said.count("open") == said.count("close") == 3 and sum(x.startswith("goto") for x in said) == said.count("close page") == 7
    assert {r.body[-8:] for r in rendered.rendered_pages(urls.limit(1), sessions_of(log)).collect()} == {"<i>2</i>"}
    with pytest.raises(ValueError):
        rendered.rendered_pages(urls, sessions_of(log), sessions=0)
