"""A fetch function over HTTP: browser-like headers, cookies, the page before as Referer, decoding, robots files."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from http.cookiejar import CookieJar
from urllib.error import HTTPError
from urllib.parse import quote, urlsplit, urlunsplit
from urllib.request import HTTPCookieProcessor, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin
from .pages import Response

# What a browser sends besides its name.
HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
    "Accept-Encoding": "gzip, deflate",
    "Upgrade-Insecure-Requests": "1",
    "Sec-Fetch-Dest": "document",
    "Sec-Fetch-Mode": "navigate",
    "Sec-Fetch-Site": "none",
    "Sec-Fetch-User": "?1",
    "DNT": "1",
}


def inflated(raw: bytes, encoding: str | None) -> bytes:
    if encoding == "gzip":
        return gzip.decompress(raw)
    if encoding == "deflate":
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return zlib.decompress(raw, -zlib.MAX_WBITS)
    return raw


def charset_of(content_type: str | None, raw: bytes) -> str:
    """From the header, else from a meta tag near the start, else UTF-8. `functions.text.charset` is the same as a column."""
    import re

    for where in (content_type or "", raw[:4096].decode("ascii", "ignore") if not content_type or "html" in content_type.lower() else ""):
        if m := re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", where):
            return m[1]
    return "utf-8"


def asked_for(url: str) -> str:
    """A URL as it can be sent: spaces and letters beyond ASCII as percent codes, the host in its ASCII form."""
    parts = urlsplit(url.strip())
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not a URL to fetch: {url!r}")
    host = parts.netloc
    if not host.isascii():
        user, at, name = host.rpartition("@")
        name, colon, port = name.partition(":")
        host = f"{quote(user)}{at}{name.encode('idna').decode()}{colon}{port}"
    own = "%/:=&?~+!$,;'@()*[]"
    return urlunsplit((parts.scheme, host, quote(parts.path, own), quote(parts.query, own), ""))


@dataclass
class HttpFetcher:
    """fetch(url) -> Response. A task gets its own copy, with its own cookies and its own page before."""

    user_agent: str
    timeout_seconds: float = 30.0
    headers: Mapping[str, str] = field(default_factory=lambda: dict(HEADERS))
    _opener: object = field(default=None, init=False, repr=False)
    _before: str | None = field(default=None, init=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_opener": None, "_before": None}

    def request(self, url: str) -> Request:
        own = {"User-Agent": self.user_agent, "Host": urlsplit(url).netloc, **self.headers}
        return Request(url, headers=own | ({"Referer": self._before} if self._before else {}))

    def __call__(self, url: str) -> Response:
        sent = asked_for(url)
        if self._opener is None:
            self._opener = build_opener(HTTPCookieProcessor(CookieJar()))
        try:
            answer = self._opener.open(self.request(sent), timeout=self.timeout_seconds)
        except HTTPError as e:  # an answer like any other; who asks judges it
            answer = e
        with answer:
            raw = inflated(answer.read(), answer.headers.get("Content-Encoding"))
            kind = answer.headers.get("Content-Type")
            try:
                body = raw.decode(charset_of(kind, raw), "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            status, final = answer.status, answer.url
        if status < 400:
            self._before = sent
        return Response(final, status, body, kind)


def robots_files(urls: DataFrame, fetch: Callable[[str], Response], origins_at_once: int = 64) -> DataFrame:
    """(origin, body) for every origin of a column `url`; one whose file can't be had has an empty one."""

    def run(batches):
        for batch in batches:
            bodies = []
            for x in batch["origin"]:
                try:
                    r = fetch(f"{x}/robots.txt")
                    bodies.append(r.body if r.status < 400 else "")
                except Exception:  # whatever keeps the file away, there are no rules then
                    bodies.append("")
            yield pd.DataFrame({"origin": batch["origin"], "body": bodies})

    origins = urls.select(origin(F.col("url")).alias("origin")).filter("origin <> ''").distinct()
    return origins.repartition(origins_at_once, "origin").mapInPandas(run, "origin string, body string")
