import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.errors import BookError
from leafmill.operators import pages as pg
from leafmill.operators import robots
from leafmill.plans import crawl, epub, site_config, toc

SITE = "http://s.example/toc"


def discover(spark, anchors, **k):
    page = "<h1>T</h1><nav>" + "".join(f'<a href="{u}">{x}</a>' for u, x in anchors) + "</nav>"
    df = spark.createDataFrame([("s", 1, SITE, page)], "site string, page_no int, url string, html string")
    return [(r.position, r.title, r.link_url) for r in toc.discover(df, ["site"], "page_no", **k).orderBy("position").collect()]


def test_discovery(spark):
    mixed = [("/n", "Notice 1"), ("/2", "Chapter 2"), ("/1", "Chapter 1"), ("/b", "Bonus"), ("/2", "again"), ("http://o.example/3", "Chapter 3"), ("", "none")]
    assert [t for _, t, _ in discover(spark, mixed)] == ["Chapter 1", "Chapter 2"]
    assert [t for _, t, _ in discover(spark, mixed, reverse=True)] == ["Chapter 2", "Chapter 1"]
    assert [t for _, t, _ in discover(spark, mixed, likely=False)] == ["Notice 1", "Chapter 2", "Chapter 1", "Bonus"]
    assert [t for _, t, _ in discover(spark, mixed, within_domain=False)] == ["Chapter 1", "Chapter 2", "Chapter 3"]
    plain = [("/n", "Notice"), ("/a", "Alpha"), ("/e", " ")]
    assert [t for _, t, _ in discover(spark, plain)] == ["Alpha", "http://s.example/e"]
    assert [t for _, t, _ in discover(spark, plain, reverse=True)] == ["http://s.example/e", "Alpha"]


def test_first_wins_whatever_the_partitions(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(200)], "k int, pos int")
    for n in (1, 7):
        got = {(r.k, r.pos) for r in toc.first_wins(rows.repartition(n), ["k"], ["pos"]).collect()}
        assert got == {(k, k) for k in range(7)}


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "page int, next_page int")
    starts = spark.createDataFrame([(1, 1), (4, 4)], "start int, page int")
    assert sorted((r.start, r.page, r.page_no) for r in toc.walk(spark, starts, edges).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (4, 4, 1)]
    assert toc.walk(spark, starts, edges, 2).count() == 3


def outcomes(spark, existing, fails, n, most, overwrite=False):
    found = spark.createDataFrame([("s", i) for i in range(1, n + 1)], "site string, idx int")
    have = spark.createDataFrame([(i, 5) for i in existing], "idx int, n_bytes long")
    rows = crawl.resume(found, have, "idx", overwrite)
    rows = rows.withColumn("status", F.when(F.col("skipped"), "skipped").when(F.col("idx").isin(*fails) if fails else F.lit(False), "failed").otherwise("fetched"))
    return [(r.idx, r.status) for r in crawl.quota(rows, ["site"], "idx", F.col("status") == "fetched", most).orderBy("idx").collect()]


def test_resume_and_quota(spark):
    assert outcomes(spark, [1], [], 2, 1) == [(1, "skipped"), (2, "fetched")]
    assert outcomes(spark, [1], [], 2, 1, overwrite=True) == [(1, "fetched")]
    assert outcomes(spark, [1], [], 3, 1) == [(1, "skipped"), (2, "fetched")]
    assert outcomes(spark, [], [1], 3, 1) == [(1, "failed"), (2, "fetched")]
    assert outcomes(spark, [], [], 3, 0) == []
    assert len(outcomes(spark, [], [], 3, None)) == 3


def test_extraction(spark):
    page = '<h1> A  b </h1><article><p>One</p><div class="ad">no</div><p>Two</p></article>'
    df = spark.createDataFrame([(1, page), (2, "<p>x"), (3, "<article> </article>")], "i int, html string")
    got = {r.i: (r.title, r.body, r.error) for r in crawl.extract_chapter(df, remove=crawl.DEFAULT_REMOVE).collect()}
    assert got == {1: ("A b", "One\nTwo", None), 2: (None, None, "content node not found"), 3: (None, "", "content is empty")}


def test_pages(spark):
    long = "word " * 200
    df = spark.createDataFrame([(1, f"<title>Ok</title><p>{long}"), (2, "<p>tiny"), (3, f"<title>Just a moment</title>{long}"), (4, f"<title>404</title>{long}"), (5, "<div id='cf-wrapper'>" + "a" * 300)], "i int, html string")
    got = {r.i: (r.bad_suspect, r.error_suspect, r.challenge_suspect) for r in pg.page_quality(df).collect()}
    assert got == {1: (False,) * 3, 2: (True, False, False), 3: (True, False, True), 4: (True, True, False), 5: (False, False, True)}


def test_robots(spark):
    files = spark.createDataFrame([("http://a", "User-agent: x\nUser-agent: leafmill\nAllow: /p/ok\nDisallow: /p\n\nUser-agent: *\nDisallow: /")], "origin string, body string")
    urls = spark.createDataFrame([("http://a/p/ok/1",), ("http://a/p/2",), ("http://a/q",), ("http://b/p",)], "url string")
    rules = robots.parse(files)
    assert {r.url: r.can_fetch for r in robots.allowed(urls, rules, "leafmill").collect()} == {"http://a/p/ok/1": True, "http://a/p/2": False, "http://a/q": True, "http://b/p": True}
    assert not any(r.can_fetch for r in robots.allowed(urls.limit(3), rules, "other").collect())


ROBOTS = [
    "User-agent: leafmill\nDisallow:\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow: /a%20b\nDisallow: /c d # x\n\nAllow: /",
    "User-agent: leafmill\nUser-agent: other\nCrawl-delay: 3\nUser-agent: third\nDisallow: /q\n\nUser-agent: *\nDisallow: /p",
    "Disallow: /\nUser-agent: leafmill\n\nDisallow: /p\nUser-agent: *\nAllow: /p/ok\nDisallow: /p",
    "user-AGENT: Leafmill/1.0\nDisallow: /p\n\nUser-agent: leaf\nDisallow: /q\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow: *\n\nUser-agent: *\nAllow: /",
    "User-agent: *\nDisallow: /p?x=1\nDisallow: /~u\nDisallow: /é",
    "",
]


def test_robots_as_the_standard_parser(spark):
    """Against urllib.robotparser, for several agents."""
    from urllib import robotparser

    paths = ["", "/", "/p", "/p/ok/1", "/p?x=1", "/q", "/a b", "/a%20b/c", "/c%20d", "/~u/x", "/%7Eu", "/é", "/%C3%A9", "/a%zz"]
    files = spark.createDataFrame([(f"http://h{i}", b) for i, b in enumerate(ROBOTS)], "origin string, body string")
    urls = spark.createDataFrame([(f"http://h{i}{p}",) for i in range(len(ROBOTS)) for p in paths], "url string")
    rules = robots.parse(files)
    for agent in ("leafmill", "Leafmill/2.0 (x)", "third", "nobody"):
        got = {r.url: r.can_fetch for r in robots.allowed(urls, rules, agent).collect()}
        assert len(got) == len(ROBOTS) * len(paths)
        for i, body in enumerate(ROBOTS):
            parser = robotparser.RobotFileParser()
            parser.parse(body.splitlines())
            for p in paths:
                assert got[f"http://h{i}{p}"] == parser.can_fetch(agent, f"http://h{i}{p}"), (agent, body, p)


def test_configs(spark):
    base = '"name":"n","start_url":"http://x/","chapter_link_selector":"a","chapter_content_selector":"p"'
    rows = ["{" + base + "}", "{" + base + ',"remove_selectors":".ad","same_domain":false}', "{" + base + ',"version":2}', "{" + base + ',"version":"x"}', '{"name":"n"}', "no"]
    got = [(r.error, r.remove_selectors, r.same_domain, r.max_toc_pages) for r in site_config.typed(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, value string")).orderBy("i").collect()]
    assert got[0] == (None, [], True, 50) and got[1][:3] == (None, [".ad"], False)
    assert [g[0] for g in got[2:]] == ["unsupported future config version", "invalid config version", "missing required config fields: start_url, chapter_link_selector, chapter_content_selector", "not a JSON object"]


CONTAINER = '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'
OPF = """<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title> Book </dc:title><dc:creator>Me</dc:creator></metadata>
<manifest><item id="a" href="T/0.xhtml"/><item id="a" href="T/1.xhtml"/><item id="b" href="T/2.xhtml"/><item id="n" href="nav.xhtml"/><item id="z" href="gone.xhtml"/></manifest>
<spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/><itemref idref="b"/><itemref idref="q"/><itemref idref="z"/></spine></package>"""


def book(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_books(spark, tmp_path):
    files = {
        "META-INF/container.xml": CONTAINER, "O/c.opf": OPF, "O/nav.xhtml": "<p>contents</p>", "O/T/1.xhtml": "<h1>Chapter 4</h1><p>x</p><img src='../I/a.PNG'/><img src='../I/no.png'/><p>y</p><img src='../I/b.bmp'/>",
        "O/T/2.xhtml": "<h1>Chapter 7</h1><p>z</p>", "O/I/a.PNG": b"1", "O/I/b.bmp": b"2",
    }
    (tmp_path / "One.EPUB").write_bytes(book(files))
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"x")
    archives = epub.read_archives(spark, str(tmp_path))
    parts = epub.members(archives)
    assert parts.filter("error IS NOT NULL").count() == 1
    packages = epub.package_files(parts)
    assert [(r.title, r.author) for r in epub.book_metadata(packages).collect()] == [("Book", "Me")]
    chapters, images, warnings = epub.import_books(archives)
    got = {r.number: r for r in chapters.collect()}
    assert sorted(got) == [4, 7] and got[4].file == "chapter_4.txt"
    assert got[4].text == "Chapter 4\n\nx\n\n[[ILLUSTRATION:004-001.png]]\n\ny\n\n[[ILLUSTRATION:004-002.img]]\n"
    assert sorted((r["index"], r.number, r.file, bytes(r.data)) for r in images.collect()) == [(1, 4, "004-001.png", b"1"), (2, 4, "004-002.img", b"2")]
    assert sorted(r.warning for r in warnings.collect()) == ["duplicate chapter number 7: Chapter 7", "not an archive: File is not a zip file"]


def encrypted(name, data):
    """An archive with one member that says it is encrypted."""
    raw = bytearray(book({"META-INF/container.xml": CONTAINER, "O/c.opf": OPF, name: data}))
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 8] |= 1
    local = int.from_bytes(raw[at + 42 : at + 46], "little")
    raw[local + 6] |= 1
    return bytes(raw)


def test_broken_members_are_warnings(spark, tmp_path):
    (tmp_path / "locked.epub").write_bytes(encrypted("O/T/1.xhtml", "<h1>Chapter 1</h1>x"))
    (tmp_path / "empty.epub").write_bytes(book({"x": "y"}))
    chapters, _, warnings = epub.import_books(epub.read_archives(spark, str(tmp_path)))
    found = sorted(r.warning for r in warnings.collect())
    assert chapters.count() == 0 and len(found) == 3 and found[0].startswith("member not readable: O/T/1.xhtml") and found[1:] == ["no META-INF/container.xml", "no readable documents in the spine"]
    for path in (tmp_path / "none", tmp_path / "text"):
        if path.name == "text":
            path.mkdir()
            (path / "a.txt").write_text("x")
        with pytest.raises(BookError):
            epub.read_archives(spark, str(path))


NAMED = """<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>A&nbsp;B &amp; C&eacute;&#33;</dc:title><dc:creator> </dc:creator><dc:creator>Me</dc:creator></metadata>
<manifest><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>"""


def test_one_broken_book_takes_no_other_down(spark, tmp_path):
    """A byte order mark, entities, document types inside and elsewhere, other encodings; a cut file, no root file, nothing in the spine."""
    told = '<!DOCTYPE package [<!ENTITY who "Else">]>' + NAMED.replace("Me", "&who;")
    elsewhere = '<?xml version="1.0"?><!DOCTYPE package PUBLIC "-//x" "http://127.0.0.1:9/never.dtd">' + NAMED
    secret = '<!DOCTYPE package [<!ENTITY f SYSTEM "file:///etc/passwd">]>' + NAMED.replace("Me", "x&f;y")
    packages = {
        "plain": NAMED.encode(), "mark": b"\xef\xbb\xbf" + NAMED.encode(), "blank": b"\n " + NAMED.encode(), "wide": NAMED.encode("utf-16"), "latin": ('<?xml version="1.0" encoding="ISO-8859-1"?>' + NAMED.replace("Me", "M\xe9")).encode("latin-1"),
        "told": told.encode(), "elsewhere": elsewhere.encode(), "secret": secret.encode(), "cut": NAMED[:150].encode(), "nothing": b"", "bare": b"<package/>", "odd": b'<?xml version="1.0" encoding="no-such"?><package/>', "deep": b"<a>" * 20_000 + b"</a>" * 20_000,
    }
    for name, package in packages.items():
        (tmp_path / f"{name}.epub").write_bytes(book({"META-INF/container.xml": CONTAINER, "O/c.opf": package, "O/1.xhtml": "<h1>Chapter 1</h1>x"}))
    (tmp_path / "boxless.epub").write_bytes(book({"META-INF/container.xml": "<container/>", "O/c.opf": NAMED}))
    (tmp_path / "pathless.epub").write_bytes(book({"META-INF/container.xml": "<container><rootfile/></container>", "O/c.opf": NAMED}))
    (tmp_path / "lost.epub").write_bytes(book({"META-INF/container.xml": CONTAINER}))
    (tmp_path / "torn.epub").write_bytes(book({"META-INF/container.xml": CONTAINER[:30]}))
    archives = epub.read_archives(spark, str(tmp_path))
    name = F.regexp_extract("path", r"(\w+)\.epub$", 1).alias("name")
    titles = {r.name: (r.title, r.author) for r in epub.book_metadata(epub.package_files(epub.members(archives).filter("error IS NULL"))).select(name, "title", "author").collect()}
    good = {"plain": "Me", "mark": "Me", "blank": "Me", "wide": "Me", "latin": "M\xe9", "told": "Else", "elsewhere": "Me", "secret": "xy"}
    assert {k: v for k, v in titles.items() if v[0]} == {k: ("A\xa0B & C\xe9!", v) for k, v in good.items()}
    chapters, _, warnings = epub.import_books(archives)
    assert sorted(r.name for r in chapters.select(name).collect()) == sorted(good)
    found = {r.name: r.warning for r in warnings.select(name, "warning").collect()}
    assert sorted(found) == sorted({"cut", "nothing", "bare", "odd", "deep", "boxless", "pathless", "lost", "torn"})
    assert found["bare"] == found["deep"] == "no readable documents in the spine" and found["lost"] == "no package document"
    assert found["cut"].startswith("package document: ") and found["torn"].startswith("META-INF/container.xml: ") and "rootfile" in found["boxless"] and "full-path" in found["pathless"]


def test_sections(spark):
    rows = [("b", 1, "Info", "s1.xhtml", "Synopsis: x"), ("b", 2, "Notice 3", "s2.xhtml", "n"), ("b", 3, "One", "s3.xhtml", "x"), ("b", 4, "Two", "s4.xhtml", "y"), ("b", 5, "Cover", "s5.xhtml", ""), ("b", 6, "", "s6.xhtml", "y")]
    df = spark.createDataFrame(rows, "book string, index int, title string, source_path string, text string")
    assert sorted((r.number, r.title) for r in epub.select_chapters(df, ["book"]).collect()) == [(1, "One"), (2, "Two")]
