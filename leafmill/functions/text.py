"""Scalar text functions as Column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed import CHAPTER_PATTERNS, IMAGE_SUFFIXES, LINE_ENDS, NOTICE_MARKERS, SECRET_NAMES

_STRIP = r"(?U)^\s+|\s+$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, for an f that names its argument more than once: x is computed once, and stands once in the plan."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, _STRIP, "")


def normalize_whitespace(x: Column) -> Column:
    # \x0B and not \v, which is a class of all vertical space in Java
    return strip(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))


def normalize_text(x: Column) -> Column:
    return normalize_whitespace(F.replace(x, F.lit(" "), F.lit(" ")))


def squeeze(x: Column) -> Column:
    """Any white space to one space, and none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def inline_breaks(x: Column) -> Column:
    """Literal <br> to a newline."""
    return F.regexp_replace(x, r"(?i)<\s*br\s*/?\s*>", "\n")


def lines(x: Column) -> Column:
    return F.split(x, LINE_ENDS)


def any_of(x: Column, markers) -> Column:
    """Whether x contains one of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(x, F.lit(m))
    return out


def chapter_number(title: Column) -> Column:
    """The explicit chapter number of a title, or null; the first pattern that hits wins."""
    t = squeeze(title)
    hits = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in CHAPTER_PATTERNS]
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    return F.translate(F.coalesce(*hits), wide, "0123456789").try_cast("bigint")


def is_notice(title: Column) -> Column:
    return any_of(F.lower(squeeze(title)), NOTICE_MARKERS)


def optional(x: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(x.cast("string")), F.lit(""))


def truncated(x: Column, most: int = 200) -> Column:
    return F.when(F.char_length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("... ("), F.char_length(x).cast("string"), F.lit(" chars total)"))).otherwise(x)


def cache_key(url: Column) -> Column:
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".html"))


def chapter_path(n: Column) -> Column:
    return F.concat(F.lit("chapter_"), n.cast("string"), F.lit(".txt"))


def chapter_file(title: Column, body: Column) -> Column:
    return F.concat(normalize_text(title), F.lit("\n\n"), strip(body), F.lit("\n"))


def illustration_name(chapter: Column, number: Column, source: Column) -> Column:
    suffix = F.lower(F.regexp_extract(source, r"[^/.](\.[^/.]+)$", 1))
    return F.concat(F.format_string("%03d-%03d", chapter, number), F.when(suffix.isin(*IMAGE_SUFFIXES), suffix).otherwise(".img"))


def first_srcset(x: Column) -> Column:
    first = F.split_part(strip(F.split_part(x, F.lit(","), F.lit(1))), F.lit(" "), F.lit(1))
    return F.nullif(first, F.lit(""))


def css_url(style: Column) -> Column:
    return optional(F.regexp_extract(style, r"(?i)url\(\s*(['\"]?)(.*?)\1\s*\)", 2))


def decode_bytes(raw: Column) -> Column:
    """UTF-8, else UTF-16 where it can be, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).when(
        (F.octet_length(raw) % 2 == 0) & F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF"), F.decode(raw, "UTF-16")
    ).otherwise(F.decode(raw, "ISO-8859-1"))


def charset(content_type: Column, body: Column) -> Column:
    """From the header, else from a meta tag in the first 4096 characters of HTML, else UTF-8."""
    header = F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w.-]+)", 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(F.left(body, F.lit(4096)), r"(?i)<meta[^>]+charset=[\"']?([\w.-]+)", 1), F.lit(""))
    is_html = F.coalesce(content_type, F.lit("")).rlike("(?i)html") | content_type.isNull()
    return F.lower(F.coalesce(header, F.when(is_html, meta), F.lit("utf-8")))


def slug_ascii(x: Column, fallback: str = "novel") -> Column:
    """Slug of ASCII text; `slugify` also decomposes other letters."""
    s = F.regexp_replace(F.lower(x), r"[^a-z0-9._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"-{2,}", "-"), r"^[._-]+|[._-]+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


@F.pandas_udf(StringType())
def ascii_of(x: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything but ASCII dropped; Spark has no normal forms."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


def slugify(x: Column, fallback: str = "novel") -> Column:
    return slug_ascii(ascii_of(x), fallback)


def recover_json(x: Column) -> Column:
    """The JSON object in a model's answer as text: whole, in a fence, or between the outer braces; null if there is none."""
    t = strip(x)
    whole = F.when(F.startswith(t, F.lit("{")), t)
    fence = F.nullif(strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)), F.lit(""))
    widest = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    ok = lambda v: F.when(F.try_parse_json(v).isNotNull(), v)
    return F.coalesce(ok(whole), ok(fence), ok(widest))


def redact_flat(x: Column) -> Column:
    """Secret members of JSON text whose values are strings or numbers; `redact` goes by structure."""
    names = "|".join(SECRET_NAMES)
    return F.regexp_replace(x, rf'(?i)"({names})"\s*:\s*("(?:[^"\\]|\\.)*"|[-0-9.eE+]+|true|false|null)', '"$1": "***REDACTED***"')


def _redacted(v):
    if isinstance(v, dict):
        return {k: "***REDACTED***" if k.lower() in SECRET_NAMES else _redacted(x) if isinstance(x, dict) else [_redacted(i) if isinstance(i, dict) else i for i in x] if isinstance(x, list) else x for k, x in v.items()}
    return v


@F.pandas_udf(StringType())
def redact(x: pd.Series) -> pd.Series:
    """JSON text with secret members masked at every level of objects; text that is no JSON stays as it is."""

    def one(v):
        try:
            return None if v is None else json.dumps(_redacted(json.loads(v)), ensure_ascii=False)
        except ValueError:
            return v

    return x.map(one)


_UNESCAPED = re.compile("&")


@F.pandas_udf(StringType())
def unescape_html(x: pd.Series) -> pd.Series:
    import html

    return x.map(lambda v: html.unescape(v) if v is not None and _UNESCAPED.search(v) else v)


#: A reference, or what stands between two.
_REFERENCES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: References that old pages write without their semicolon, the longest of them, and what numbers of the C1 range stand for in pages.
_BARE = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST = max(map(len, _BARE))
_C1 = "".join(bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0))


def _of_code(code: Column) -> Column:
    """The character of a code point as references mean it; null is one beyond all."""
    beyond = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(beyond, "\ufffd").when(code.between(0x80, 0x9F), F.substring(F.lit(_C1), (code - 0x7F).cast("int"), F.lit(1))).when(none, "").otherwise(char)


def unescaped(x: Column) -> Column:
    """All character references of HTML, named and numeric, with or without their semicolons, as html.unescape reads them; without leaving the JVM."""
    table = lambda names: F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # noqa: E731  one literal once the plan is folded
    every, bare = table(html5), table(_BARE)

    def one(token: Column) -> Column:
        name = F.substring(token, 2, 40)
        digits = F.regexp_replace(F.regexp_extract(token, r"^&#[xX]?0*([0-9a-fA-F]*)", 1), "^$", "0")
        number = F.when(token.rlike("^&#[xX]"), F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("bigint"))).otherwise(F.when(F.length(digits) <= 10, digits.try_cast("bigint")))
        # no whole name: the longest that it begins with
        begun = [F.when(F.length(name) > n, F.concat(F.try_element_at(bare, F.left(name, F.lit(n))), F.substring(name, n + 1, 40))) for n in range(_LONGEST, 1, -1)]
        common = F.when(name == "amp;", "&").when(name == "lt;", "<").when(name == "gt;", ">").when(name == "quot;", '"').when(name == "nbsp;", "\xa0")  # what most of them are, without a search
        named = F.coalesce(common, F.try_element_at(every, name), *begun, token)
        return F.when(~F.startswith(token, F.lit("&")) | (token == "&"), token).when(F.startswith(token, F.lit("&#")), F.when(token.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), _of_code(number)).otherwise(token)).otherwise(named)

    return let(x, lambda v: F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(_REFERENCES), 0), one), "")).otherwise(v))
