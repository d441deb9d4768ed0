"""Pages from a browser: sessions that tasks hold open, clicks that expand a page until nothing more comes of them.

What drives the browser is given: a function that opens a session. Each task has one session for all of its pages, and there are as many tasks as sessions may be
open at once. An origin's pages are one task's, in turn, with the gap between them; a session that has died is opened anew once a page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority
from .pages import PAGES, Politeness, Response, Throttle, fetch_one

#: Rounds of clicks on one page, at most, and how long one waits for something to come of it.
MOST_ROUNDS, WAIT_SECONDS = 50, 5.0


class Page(Protocol):
    """A page of a session."""

    def goto(self, url: str) -> int | None: ...
    def count(self, selector: str) -> int: ...
    def click(self, selector: str) -> None: ...
    def grown(self, selector: str, before: int, seconds: float) -> None: ...
    def content(self) -> str: ...
    def url(self) -> str: ...
    def close(self) -> None: ...


class Session(Protocol):
    def new_page(self) -> Page: ...
    def close(self) -> None: ...


class ClickError(ValueError):
    """A click that can't be made; asking again doesn't help."""


def expand(page: Page, clicks: Sequence[str], grows: str | None, most_rounds: int = MOST_ROUNDS) -> int:
    """Click until the matches of `grows` are no more than before, and return how often that was; without `grows` every selector is clicked once. What isn't
    there in the first round is an error; what has gone later is done."""
    rounds = 0
    while rounds < most_rounds:
        before = page.count(grows) if grows else 0
        clicked = False
        for selector in clicks:
            if page.count(selector) < 1:
                if not rounds:
                    raise ClickError(f"Expand selector did not match: {selector}")
                continue
            try:
                page.click(selector)
            except Exception as e:
                if rounds:
                    continue
                raise ClickError(f"Could not click expand selector {selector}: {e}") from e
            clicked = True
        if not clicked:
            break
        rounds += 1
        if not grows:
            break
        page.grown(grows, before, WAIT_SECONDS)
        if page.count(grows) <= before:
            break
    return rounds


class _Held:
    """A task's session."""

    def __init__(self, open_session: Callable[[], Session], clicks: Sequence[str], grows: str | None):
        self._open, self._clicks, self._grows = open_session, clicks, grows
        self._session: Session | None = None

    def _page(self) -> Page:
        for again in (True, False):
            if self._session is None:
                self._session = self._open()
            try:
                return self._session.new_page()
            except Exception:
                self.close()
                if not again:
                    raise
        raise AssertionError

    def __call__(self, url: str) -> Response:
        try:
            page = self._page()
            try:
                status = page.goto(url)
                if status is None:
                    raise OSError(f"No response from page: {url}")
                if self._clicks:
                    expand(page, self._clicks, self._grows)
                return Response(page.url(), status, page.content(), "text/html")
            finally:
                page.close()
        except ClickError:
            raise
        except Exception as e:  # whatever a driver raises may pass
            raise OSError(f"Browser error while fetching {url}: {e}") from e

    def close(self) -> None:
        session, self._session = self._session, None
        if session is not None:
            try:
                session.close()
            except Exception:  # it is gone already
                pass


def rendered_pages(urls: DataFrame, open_session: Callable[[], Session], rules: Politeness | None = None, sessions: int = 4, clicks: Sequence[str] = (), grows: str | None = None) -> DataFrame:
    """Pages for a column `url`, as `sources.pages.fetch_pages` gives them, from at most `sessions` sessions at once."""
    if sessions < 1:
        raise ValueError("at least one session")
    polite = rules or Politeness()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap, held = Throttle(polite), _Held(open_session, clicks, grows)
        try:
            for batch in batches:
                for url, host in zip(batch["url"], batch["__host"]):
                    yield pd.DataFrame([fetch_one(url, held, polite, lambda host=host: gap.wait(host))]).astype({"status": "Int32"})
        finally:
            held.close()

    return urls.select("url", F.lower(authority(F.col("url"))).alias("__host")).repartition(sessions, "__host").mapInPandas(run, PAGES)


def expanding_source(open_session: Callable[[], Session], grows: str | None, rules: Politeness | None = None, sessions: int = 4) -> Callable[[DataFrame, str], DataFrame]:
    """What `sources.pages.toc_pages` takes for sites whose contents have to be clicked open."""
    return lambda urls, selector: rendered_pages(urls, open_session, rules, sessions, [selector], grows)
