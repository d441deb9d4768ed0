import html
import posixpath
import unicodedata
from urllib.parse import quote, unquote, urljoin

import pytest
from pyspark.sql import functions as F

from leafmill.functions import html as h
from leafmill.functions import text as t
from leafmill.functions import urls as u
from leafmill.functions.selectors import SelectorError, fault


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


TITLES = {
    "3화": 3, "제 12 장 시작": 12, "12장": 12, "第5章 雨": 5, "第 7 話": 7, "Chương 8": 8, "chuong 9: x": 9, "CHƯƠNG 4": 4, "Chapter 10": 10, "chap. 11": 11, "Ch #12": 12, "Episode 13": 13, "ep.14": 14,
    "Chapter\xa015": 15, "Chapter １６": 16, "42": None, "Cover": None, "": None, "Chapters": None, "1화2": None, "Part 3": None,
}


def test_chapter_numbers(spark):
    assert column(spark, list(TITLES), t.chapter_number) == list(TITLES.values())


def test_notices(spark):
    assert column(spark, ["NOTICE: x", "공지 3", "公告", "Story", "an  Announcement"], t.is_notice) == [True, True, True, False, True]


def test_text(spark):
    raw = ["\xa0 a \t b\x0bc\n\n d ", "", "　x　"]
    assert column(spark, raw, t.normalize_text) == ["a b c\n\n d", "", "x"]
    assert column(spark, ["a<BR />b"], t.inline_breaks) == ["a\nb"]
    assert column(spark, ["Café ＡＢ/c?", "--", "đ", "a__b..c"], t.slugify) == ["cafe-ab-c", "novel", "novel", "a__b..c"]
    assert column(spark, ["x" * 203], t.truncated) == ["x" * 200 + "... (203 chars total)"]
    assert column(spark, [" ", " a ", None], t.optional) == [None, "a", None]
    assert column(spark, [" a.jpg 1x, b.jpg 2x", ""], t.first_srcset) == ["a.jpg", None]
    assert column(spark, ["background:url( 'x y.png' )", "url(z.png)", "none"], t.css_url) == ["x y.png", "z.png", None]
    once = column(spark, raw, t.normalize_text)
    assert column(spark, once, t.normalize_text) == once


def test_bytes(spark):
    raw = ["é".encode(), b"\xe9", "aé".encode("utf-16")]
    assert column(spark, raw, t.decode_bytes, "binary")[:2] == ["é", "é"]
    assert column(spark, raw, t.decode_bytes, "binary")[2].lstrip("﻿") == "aé"


def test_json(spark):
    raw = [' {"a": 1} ', 'x\n```json\n{"a": 2}\n```', "so {\"a\": 3} ok", "none", "{bad"]
    assert [x and x.replace(" ", "") for x in column(spark, raw, t.recover_json)] == ['{"a":1}', '{"a":2}', '{"a":3}', None, None]
    deep = '{"API_KEY": "x", "a": {"token": 1, "b": [{"secret": 2}, 3]}}'
    assert column(spark, [deep], t.redact) == ['{"API_KEY": "***REDACTED***", "a": {"token": "***REDACTED***", "b": [{"secret": "***REDACTED***"}, 3]}}']
    assert column(spark, ["a &amp;lt; &eacute;"], t.unescape_html) == [html.unescape("a &amp;lt; &eacute;")]


BASES = ["http://h.example/a/b/c?x=1#f", "https://h.example:81", "http://u@h.example/"]
REFS = ["../x", "./y?z", "?q", "#g", "//o/p", "/r/../s/.", "../../../t", "http://z/", "", "w/..", "k:v"]


@pytest.mark.parametrize("base", BASES)
def test_urljoin(spark, base):
    got = column(spark, REFS, lambda c: u.urljoin(F.lit(base), c))
    for ref, x in zip(REFS, got):
        if ref not in ("k:v",):
            assert x == urljoin(base, ref), (base, ref)


def test_paths(spark):
    paths = ["a/./b/../c", "../x", "a//b", "", "a/../.."]
    assert column(spark, paths, u.norm_path) == [posixpath.normpath(p) for p in paths]
    refs = ["../Images/a%20b+c.png#x", "/top.png", "http://x/y", "", "b.png"]
    assert column(spark, refs, lambda c: u.resource_path(F.lit("OEBPS/Text/s.xhtml"), c)) == ["OEBPS/Images/a b+c.png", "top.png", None, None, "OEBPS/Text/b.png"]
    assert column(spark, ["http://a.b/c/d/", "http://a.b"], u.config_name) == ["d", "a-b"]


MORE_REFS = ["#", "#x", "?", "a#", "a?", "a?#", "a?#f", "a//b", "a//", "../..//x", "/a//b", "http:g", "http:", "HTTP:g", "http:?q", "https:g", "mailto:x", "http://o/?#", "http://o//x", "//o/#", "//o", "./", "..", "a/./", "a/../", ".", ";p", "a;p?q", "g?y/./x", "g#s/../x"]


def test_urljoin_beside_the_standard(spark):
    for base in ("http://h.example/b/c?d=1#f", "http://h.example", "http://h.example/", "http://h.example/a//b/", "https://h.example/x/y/z"):
        got = column(spark, MORE_REFS, lambda c: u.urljoin(F.lit(base), c))  # noqa: B023
        assert dict(zip(MORE_REFS, got)) == {r: urljoin(base, r) for r in MORE_REFS}, base


REFERENCES = [
    "a &amp; b", "&lt;p&gt;", "&amp;lt;", "&nbsp;x&copy;&middot;", "&eacute;&Eacute;&hellip;&mdash;", "&notit;", "&notin;", "&not", "&copy2", "&amp", "AT&T", "&", "&&amp;&", "&;", "& amp;", "&frac12;&frac12x", "&CounterClockwiseContourIntegral;",
    "&#65;&#x41;&#X41;&#65&#x41g", "&#0;&#xD800;&#x110000;&#99999999999;&#x99999999999;", "&#128;&#x80;&#129;&#150;", "&#1;&#11;&#13;&#9;&#127;&#xFDD0;&#xFFFE;&#x1FFFF;", "&#128512;&#x1F600;", "&#;&#x;&#xg;&#a", "&nosuch;", "&nosuchnameatall", "&acE;", "&fj;lig&fjlig;", "&lt&gt",
    "&#000065;&#x000000041;", "é&eacute", "x" * 50 + "&amp;" + "y" * 50, "&" + "a" * 60, "", "\n&amp;\r\n",
]


def test_references_as_the_standard_library_reads_them(spark):
    got = column(spark, REFERENCES, t.unescaped)
    assert dict(zip(REFERENCES, got)) == {x: html.unescape(x) for x in REFERENCES}
    assert column(spark, [None], t.unescaped) == [None]


def test_hrefs_in_any_quotes(spark):
    page = "<a href=/1>a</a><a class='x' href='/2&amp;y'>b</a><a HREF = \"/3\">c</a><a data-href='/no'>d</a><a\nhref=/4 id=x>e</a><a title='href=/no'>f</a><a href=''>g</a>"
    df = spark.createDataFrame([(page,)], "html string")
    assert [r.href for r in h.anchors(df).orderBy("pos").collect()][:4] == ["/1", "/2&y", "/3", "/4"]


def test_plain_text(spark):
    page = "<div>One <b>two</b><br>three<script>x</script><!-- no --> &amp; four</div>"
    assert column(spark, [page], h.plain_text) == ["One\ntwo\nthree\n& four"]


def test_select():
    page = "<ul id=l><li class='a b'><a href=/1>x</a></li><li><a class=n href=/2>y<i>z</i></a></li></ul><p><a href=/3>w</a>"
    tree = h.parsed(page)
    hrefs = lambda s: [n[1].get("href") for n in h.select(tree, s)]
    assert hrefs("a") == ["/1", "/2", "/3"]
    assert hrefs("#l a") == ["/1", "/2"] and hrefs("li.a.b > a") == ["/1"] and hrefs("ul > a") == [] and hrefs("a.n, p a") == ["/2", "/3"]
    assert hrefs("a[href='/3']") == ["/3"] and hrefs("a[href^='/']") == ["/1", "/2", "/3"]


SELECTOR_FAULT = object()
PAGE = """<html><body><div id=top class="a b"><h1>T</h1><p class=x>1</p><p title="x y">2</p><span>s</span><p lang=en-GB title="p,q">3</p><h1>U</h1><p id="i:d">4</p></div>
<ul><li>a</li><li class=n>b</li><li>c<ul><li>d</li><li class=n>e</li></ul></li><li>f</li><li class=n>g</li></ul><div></div><div> <!-- c --></div><em>only</em><a href="/1" data-n=5>l</a><a>m</a></body></html>"""

#: A selector and the texts of what it finds.
SELECTORS = {
    "p:nth-of-type(2)": ["2"], "p:nth-of-type(odd)": ["1", "3"], "p:nth-last-of-type(1)": ["4"], "#top > :nth-child(2n+1)": ["T", "2", "3", "4"], "#top > *:nth-last-child(-n + 2)": ["U", "4"], "#top p:nth-child(4n-1)": ["2", "4"],
    "h1 + p": ["1", "4"], "h1 ~ p": ["1", "2", "3", "4"], "p ~ h1": ["U"], "h1~h1+p": ["4"], "h1 + span": [], "p:not(.x, [title])": ["4"], "#top :not(p):not(h1)": ["s"], "p:first-of-type": ["1"], ":first-child:not(body *)": None,
    '[title="x y"]': ["2"], '[title="p,q"]': ["3"], "[title='p,q'], [title=\"x y\"]": ["2", "3"], r"#i\:d": ["4"], r"#i\3a d": ["4"], "[lang|=en]": ["3"], "[lang|=e]": [], "[title~=y]": ["2"], "[title^='x']": ["2"], "[title$=q]": ["3"],
    "[title*=',']": ["3"], "[title*='']": [], "[lang='EN-gb' i]": ["3"], "[lang='EN-gb']": [], "p[title!='x y']": ["1", "3", "4"], "[data-n='5']": ["l"], "ul ul li:last-child": ["e"], "ul > li:nth-child(2 of .n)": ["g"],
    "li:nth-child(-n+2 of :not(.n))": ["a", "cde", "d"], "li:has(> ul)": ["cde"], "li:has(li.n)": ["cde"], "p:has(+ h1)": ["3"], "h1:has(~ span)": ["T"], "h1:has(+ p.x)": ["T"], "div:has(p):has(span)": None, ":is(h1, span)": ["T", "s", "U"],
    "div:empty": ["", " "], "em:only-of-type": ["only"], "p:contains('4')": ["4"], "a:link": ["l"], "a:not([href])": ["m"], "DIV.b H1:last-of-type": ["U"], "a:hover": [], "li.n , em": ["b", "e", "g", "only"], "ul/* x */li li": ["d", "e"],
    "body > ul > li:nth-child(3) li + li": ["e"], "div.a.b>h1": ["T", "U"], "*|x": SELECTOR_FAULT, "p:": SELECTOR_FAULT, "p:nth-child(x)": SELECTOR_FAULT, "p >": SELECTOR_FAULT, "> p": SELECTOR_FAULT, "a[href": SELECTOR_FAULT, "": SELECTOR_FAULT, "p::before": SELECTOR_FAULT,
    "a,,b": SELECTOR_FAULT, ":frob": SELECTOR_FAULT, ":not(": SELECTOR_FAULT, "p)": SELECTOR_FAULT, "a[b=c d]": SELECTOR_FAULT, ":not(" * 40 + "a" + ")" * 40: SELECTOR_FAULT, "a { b }": SELECTOR_FAULT, "[x='1]": SELECTOR_FAULT,
}


def test_selectors():
    tree = h.parsed(PAGE)
    for selector, want in SELECTORS.items():
        if want is SELECTOR_FAULT:
            assert (fault(selector) or "").startswith("selector not understood: "), selector
            with pytest.raises(SelectorError):
                h.select(tree, selector)
        elif want is not None:
            assert fault(selector) is None and ["".join(h._texts(n)) for n in h.select(tree, selector)] == want, selector
    assert [n[0] for n in h.select(tree, "div:has(p):has(span)")] == ["div"] and [n[0] for n in h.select(tree, ":root")] == ["html"]
    # many siblings and deep nesting take neither long nor the stack
    wide = h.parsed("<p>" + "<b>x</b><i>y</i>" * 20_000)
    assert len(h.select(wide, "b ~ i:nth-of-type(2n)")) == 10_000 and len(h.select(wide, "p:has(b + i) > b:nth-last-child(2)")) == 1
    deep = h.parsed("<div>" * 5000 + "<p class=c>x")
    assert len(h.select(deep, "div div div > p")) == 1 and len(h.select(deep, "div:has(p)")) == 5000 and len(h.select(deep, "div + div p, p:not(div div *)")) == 0


def test_a_page_may_be_nested_deeply():
    page = "<div>" * 5000 + "a<b>b</b>c" + "</div>" * 5000
    assert h.skeleton_text(page, 10**9).count("<div>") == 5000
    assert h.chapter_of(page, "div", None, ["b"]) == (None, "ac", None)
    assert h.chapter_of("<p>a<b>b</b>c<br>d<script>x</script>e<!-- n -->f</p>", "p", "b", []) == ("b", "a\nb\nc\nd\nef", None)


def test_a_bad_selector_is_a_rows_error(spark):
    df = spark.createDataFrame([("<p>a", "p:first-child"), ("<p>a", "p::x"), ("<p>a", None)], "page string, sel string")
    got = df.select(F.size(h.css_select("page", "sel")).alias("n"), h.selector_fault("sel").alias("wrong"), h.chapters_of(F.col("page"), "p[", None, []).alias("c"), h.css_select_all(F.col("page"), ["p", "p["]).alias("all")).collect()
    assert [(r.n, r.wrong) for r in got] == [(1, None), (None, "selector not understood: a pseudo-element at 1 of 'p::x'"), (None, None)]
    assert all(r.c.body is None and r.c.error.startswith("selector not understood") and len(r.all[0]) == 1 and r.all[1] is None for r in got)


def test_select_column(spark):
    df = spark.createDataFrame([("<p>a<p class=x>b", "p.x"), (None, "p")], "page string, sel string")
    got = [r.x for r in df.select(h.css_select("page", "sel").alias("x")).collect()]
    assert [(n.pos, n.tag, n.attrs, n.text) for n in got[0]] == [(0, "p", {"class": "x"}, "b")] and got[1] is None


def test_section():
    title, text, images = h.parse_section("<head><title>t</title></head><body><h2>Ch <b>1</b></h2><p>a<img src='i.png'/>b &amp;lt; c</p><p>d</p></body>")
    assert (title, images) == ("Ch 1", ["i.png"])
    assert text == "Ch 1\n\na\n\n[[EPUB_IMAGE:1]]\n\nb < c\n\nd"


def test_skeleton():
    got = h.skeleton_text("<div id=a onclick=x><script>1</script><!-- c --><p>" + "y" * 90 + "</p></div>")
    assert "script" not in got and "onclick" not in got and 'id="a"' in got and "y" * 40 + "…" in got and "y" * 41 not in got
    assert h.skeleton_text("<p>abcdef</p>", 5).endswith("<!-- truncated -->")


def test_nfkd_is_needed(spark):
    x = "ﬁÀ²"
    assert column(spark, [x], lambda c: t.ascii_of(c)) == [unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()]


def test_broken_percent_codes_and_json(spark):
    row = spark.createDataFrame([("a%zz+b%20c%", "no json", '{"token": 1, "a": [{"Secret": 2}]}')], "u string, j string, k string")
    got = row.select(u.unquoted(F.col("u")), t.redact(F.col("j")), t.redact(F.col("k"))).first()
    assert tuple(got) == ("a%zz+b c%", "no json", '{"token": "***REDACTED***", "a": [{"Secret": "***REDACTED***"}]}')
    for x in ("", "/p q", "/a~b*c", "/é/ü?x=1&y", "%", "/%41"):
        want = quote(unquote(x))
        assert spark.range(1).select(u.percent_encoded(u.percent_decoded(F.lit(x)))).first()[0] == want


SECTIONS = {
    "a</div>b<p>c<p>d<div>e": ("", "a\n\nb\n\nc\n\nd\n\ne", []),
    "<h2> </h2><h3>Real <i>one</i></h3>x<h1>late</h1>": ("Real one", "Real one\n\nx\n\nlate", []),
    "<script>no</script><svg><image href='v.svg'/>t</svg><image xlink:href='a.png'></image>z": ("", "[[EPUB_IMAGE:1]]\n\nz", ["a.png"]),
    "<img alt='x'><img src='a&amp;b.png'>one<br>two &lt;br/&gt; three": ("", "[[EPUB_IMAGE:1]]\n\none\n\ntwo\n\nthree", ["a&b.png"]),
    "<title>T</title><p>x\ty  \u00a0 z": ("T", "T\n\nx y \u00a0 z", []),
    "": ("", "", []),
    "<p>" * 3000 + "deep": ("", "deep", []),
}


@pytest.mark.parametrize("markup", SECTIONS)
def test_sections(markup):
    assert h.parse_section(markup) == SECTIONS[markup]


def test_all_selectors_in_one_parse(spark):
    page = spark.createDataFrame([("<h1 class=t>A</h1><nav><a href=1>x</a><a href=2>y</a></nav>",), (None,)], "html string")
    first, none = page.select(h.css_select_all(F.col("html"), ["nav > a", None, ".t", "p"]).alias("m")).collect()
    assert none.m is None and [None if m is None else [(n.tag, n.text) for n in m] for n_ in (0,) for m in first.m] == [[("a", "x"), ("a", "y")], None, [("h1", "A")], []]
