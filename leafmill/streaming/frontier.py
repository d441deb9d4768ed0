"""A crawl frontier as a stream: URLs come in any order and as often as they like, pages go out, and each origin's queue, what it has seen
and when it was last asked are state that outlives the query.

An origin is a key of `transformWithStateInPandas`. Its queue and its seen URLs are maps in the state store, so neither a long queue nor a large site is
ever held in memory; a timer wakes an origin that has something to do. When it is awake it makes requests for `burst_seconds` at most, one after the
other, and no two of them, retries included, start closer together than the gap, over all batches and restarts: the last start is state, too. A URL is
asked for once, however often it comes. After a kill the query goes on from its checkpoint: what a committed batch fetched is not fetched again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.urls import authority
from ..sources.pages import PAGES, Politeness, Response, _asked, _page

#: What comes out: pages as other sources give them, when the last attempt started, and how many URLs wait behind it.
FETCHED = f"origin string, {PAGES}, started double, waiting long"
_COLUMNS = [c.split()[0] for c in FETCHED.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Origin(StatefulProcessor):
    def __init__(self, fetch: Callable[[str], Response], rules: Politeness, burst_seconds: float):
        self._fetch, self._rules, self._burst = fetch, rules, burst_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getMapState("seen", "url string", "once boolean")
        self._queue = handle.getMapState("queue", "place long", "url string, attempt int, not_before double")
        self._ends = handle.getValueState("ends", "head long, tail long, last double")

    def _state(self) -> tuple[int, int, float]:
        found = self._ends.get()
        return (0, 0, 0.0) if found is None else (int(found[0]), int(found[1]), float(found[2]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, last = self._state()
        idle = head == tail
        for batch in rows:
            for url in batch["url"]:
                if not self._seen.containsKey((url,)):
                    self._seen.updateValue((url,), (True,))
                    self._queue.updateValue((tail,), (url, 1, 0.0))
                    tail += 1
        self._ends.update((head, tail, last))
        if idle and head < tail:
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, tail, last = self._state()
        rules, until, out = self._rules, self._rules.clock() + self._burst, []
        wake = 0.0
        while head < tail:
            url, attempt, not_before = self._queue.getValue((head,))
            wake = max(last + rules.delay_seconds, float(not_before))
            if wake > until:
                break
            while (left := wake - rules.clock()) > 0:
                rules.sleep(left)
            last = rules.clock()
            r, error, again = _asked(url, self._fetch)
            self._queue.removeKey((head,))
            head += 1
            if r is None and again and attempt < rules.attempts:
                # behind the others, which use the time that it has to wait
                self._queue.updateValue((tail,), (url, int(attempt) + 1, rules.clock() + rules.backoff_seconds * int(attempt)))
                tail += 1
            else:
                out.append((key[0], *_page(url, r, int(attempt), error).values(), last, tail - head))
        self._ends.update((head, tail, last))
        if head < tail:
            self._handle.registerTimer(int(max(timerValues.getCurrentProcessingTimeInMs() + 1, wake * 1000)))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"status": "Int32"})

    def close(self) -> None:
        pass


def fetched(urls: DataFrame, fetch: Callable[[str], Response], rules: Politeness | None = None, burst_seconds: float = 5.0) -> DataFrame:
    """A stream of pages for a stream with a column `url`. Null URLs are left out; one without an origin is a page with an error like any other."""
    polite = rules or Politeness(clock=time.time)
    keyed = urls.filter("url IS NOT NULL").select(F.lower(authority(F.col("url"))).alias("origin"), "url")
    return keyed.groupBy("origin").transformWithStateInPandas(_Origin(fetch, polite, burst_seconds), FETCHED, "append", "processingTime")


def run(urls: DataFrame, out: str, checkpoint: str, fetch: Callable[[str], Response], rules: Politeness | None = None, burst_seconds: float = 5.0, every: str = "1 second") -> StreamingQuery:
    """Start or go on with a crawl: pages as Parquet files in out, each once. Rules whose clock is not the wall clock's (time.time) do not outlive the process."""
    conf = urls.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        pages = fetched(urls, fetch, rules, burst_seconds)
        return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def until_idle(query: StreamingQuery, quiet_seconds: float, most_seconds: float = 86_400) -> bool:
    """Wait until a query has read and changed nothing for so long (longer than the gap and any backoff), then stop it. Whether it came to that."""
    began, seen, since = time.monotonic(), -1, None
    while time.monotonic() - began < most_seconds and query.isActive:
        for p in query.recentProgress:
            if p.batchId > seen:
                seen, at = p.batchId, datetime.fromisoformat(p.timestamp)
                if p.numInputRows or any(s.numRowsUpdated or s.numRowsRemoved for s in p.stateOperators):
                    since = None
                else:
                    since = since or at
                    if (at - since).total_seconds() >= quiet_seconds:
                        query.stop()
                        return True
        time.sleep(0.2)
    if query.exception():
        raise query.exception()
    return False
