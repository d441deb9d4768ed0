"""The frontier against a recorded clock, across a kill."""

import os
import time
from collections import Counter

from leafmill.sources.pages import Politeness, Response
from leafmill.streaming import frontier

GAP = 0.2


def recorder(path):
    """A fetch function that appends each start to a file, and fails as the URL says."""

    def fetch(url):
        with open(path, "a") as f:
            f.write(f"{time.time()} {url}\n")
        with open(path) as f:
            times = sum(line.split()[1] == url for line in f)
        if "flaky" in url and times < 2 or "down" in url:
            return Response(url, 503, "")
        if "odd" in url:
            raise ValueError("no such URL")
        return Response(url + "/", 200, "body of " + url, "text/html")

    return fetch


def starts(path):
    out = {}
    for line in open(path):
        at, url = line.split()
        out.setdefault(url.split("/")[2], []).append((float(at), url))
    return out


def test_gap_and_restart(spark, tmp_path):
    log, land, out, check = (str(tmp_path / x) for x in ("log", "land", "out", "check"))
    open(log, "w").close()
    rules = Politeness(3, 0.1, GAP, time.sleep, time.time)

    def put(urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(land)

    def stream():
        return spark.readStream.schema("url string").parquet(land)

    first = [f"http://a/{i}" for i in range(14)] + ["http://a/flaky", "http://b/down", "http://b/odd", "http://b/1", "http://B/1", None]
    put(first + first)  # each twice
    query = frontier.run(stream(), out, check, recorder(log), rules, burst_seconds=0.5, every="100 milliseconds")
    # killed in the middle
    end = time.time() + 90
    while time.time() < end and sum(map(len, starts(log).values())) < 8:
        time.sleep(0.05)
    query.stop()
    early = sum(map(len, starts(log).values()))
    assert 8 <= early < 20
    done = {r.url for r in spark.read.schema(frontier.FETCHED).parquet(out).collect()} if os.path.exists(out) else set()
    before = Counter(u for x in starts(log).values() for _, u in x)
    put(["http://a/2", "http://c/1", "http://a/20"])
    query = frontier.run(stream(), out, check, recorder(log), rules, burst_seconds=0.5, every="100 milliseconds")
    assert frontier.until_idle(query, 2, 150)
    pages = {r.url: r for r in spark.read.parquet(out).collect()}
    assert set(pages) == {u for u in [*first, "http://c/1", "http://a/20"] if u} and spark.read.parquet(out).count() == len(pages)
    assert pages["http://a/3"].body == "body of http://a/3" and pages["http://a/3"].final_url == "http://a/3/" and pages["http://a/3"].status == 200
    assert (pages["http://a/flaky"].error, pages["http://b/down"].error, pages["http://b/down"].attempts, pages["http://b/odd"].error) == (None, "HTTP 503", 3, "ValueError: no such URL")
    asked = Counter(u for x in starts(log).values() for _, u in x)
    # what was committed before the kill is not asked for again; nothing is more than the batch that was cut off again
    assert all(asked[u] == before[u] for u in done) and all(asked[u] <= 2 for u in pages if "flaky" not in u and "down" not in u)
    for origin, times in starts(log).items():
        at = [t for t, _ in times]
        # a batch that was cut off leaves no last start, so its repetition may follow closely
        close = sum(b - a < GAP - 0.005 for a, b in zip(at, at[1:]))
        assert close <= 1, (origin, times)
