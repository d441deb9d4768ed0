import hashlib
import io
import re
import warnings
import zipfile
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from leafmill import catalogue
from leafmill.plans import epub, toc
from leafmill.session import bounded_batches


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_normalized_text_is_whole(spark, tmp_path):
    texts = ["a\t\tb\xa0 c", "word \t word\r\n\f" * 400, "x" * 299 + " \x0b\xa0 y" * 300, ""]
    got = {r.doc_id: r.text for r in catalogue.normalized_text(spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {i: re.sub(r"[ \t\r\f\v]+", " ", f"  \t{x} \f x\n ".replace("\xa0", " ")).strip() for i, x in enumerate(texts)}


def test_marker_substitution_takes_every_whole_text(spark, tmp_path):
    texts = ["short", "a\n\n\n\nb" * 30, "\n\n\nx", "x" * 90 + "\n\n\n" + "y" * 50, "line\n" * 100, "", "tail\n\n\n\n"] * 5

    def brute(i, text):
        n, marks = 0, []
        for keep in (i % 2 == 0, i % 3 == 0, i % 5 == 0):
            n += keep
            marks.append(f"[[EPUB_IMAGE:{n}]]" if keep else "")
        return re.sub(r"\n{3,}", "\n\n", f"{marks[0]}\n\n{text}\n\n{marks[1]}\n\nend\n\n{marks[2]}").strip("\n")

    got = {r.doc_id: r.text for r in catalogue.marker_substitution(spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {i: brute(i, x) for i, x in enumerate(texts)}


def brute_walks(ids, following, most):
    rows = []
    for start in ids:
        seen = [start]
        while len(seen) < most and (after := following.get(seen[-1])) is not None and after not in seen:
            seen.append(after)
        rows += [(start, page, no) for no, page in enumerate(seen, 1)]
    return sorted(rows)


def test_toc_walk_starts_from_every_page(spark, tmp_path):
    ids = range(1, 102)
    spark.createDataFrame([(i,) for i in ids], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    want = brute_walks(ids, {i: (i * 7 + 3) % 101 for i in ids}, 50)
    assert {start for start, _, _ in want} == set(ids) and max(no for _, _, no in want) == 50
    assert sorted(tuple(r) for r in catalogue.toc_walk(spark, str(tmp_path)).collect()) == want


def test_many_walks_pass_the_sessions_row_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "page long, next_page long")
    starts = spark.createDataFrame([(i, i) for i in range(20)], "start long, page long")
    want = brute_walks(range(20), {i: i + 1 for i in range(60)}, 50)
    assert sorted(tuple(r) for r in toc.walk(spark, starts, edges).collect()) == want


def test_queries_that_write_or_stream(spark, tmp_path):
    """cache_store against a dict, frontier_pages against a loop; some URLs come several times."""
    rows = [(i, f"http://h{i % 3}.example/{'spam' if i % 4 == 1 else 'p'}/{i % 30}", f"<p>{i}") for i in range(36)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    key = {u: hashlib.sha256(u.encode()).hexdigest()[:16] + ".html" for _, u, _ in rows}
    cache = {}

    def put(some):
        new = {}
        for u, body in some:
            new[key[u]] = max(new.get(key[u], ""), body, key=lambda b: (len(b), b))
        cache.update(new)

    put((u, b) for _, u, b in rows)
    put((u, f"second {u}") for i, u, _ in rows if i % 3 == 0)
    for i, u, _ in rows:
        if i % 5 == 0:
            cache.pop(key[u], None)
    put((u, f"third {u}") for i, u, _ in rows if i % 7 == 0)
    assert {r.key: r.body for r in catalogue.cache_store(spark, str(tmp_path)).collect()} == cache
    got = sorted(tuple(r) for r in catalogue.frontier_pages(spark, str(tmp_path)).collect())
    assert got == sorted((u, None, None, 2, "no route") if "spam" in u else (u, u + "/", "body of " + u, 1, None) for u in {u for _, u, _ in rows})


#: A heading cut off within a reference, as the given tables have them, and references that go on, are numbers, or are none.
CUT = ["a &amp", "b &amp;&amp;&am", "c &amp;lt; &lt;d", "e &copy f &copyg; &#39;h &#39 &", "plain"]


def same_as_sql(spark, folder, name, pages):
    """Whether a query over such pages gives what its SQL does, row for row."""
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, str(folder)).collect()) == Counter(map(tuple, want.fetchall()))


def cut_pages():
    return [(i, f"https://h.example/{i}", f"<html><head><title>t</title></head><body><article><h1>{x}</h1><p>{x}</p>text &amp; more</article></body></html>") for i, x in enumerate(CUT)]


def test_article_text_of_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "article_text", cut_pages())


def test_chapter_by_selectors_of_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "chapter_by_selectors", cut_pages())


def test_chapter_text_file_of_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "chapter_text_file", cut_pages())


def test_page_metadata_of_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "page_metadata", cut_pages())


def test_section_text_of_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "section_text", cut_pages())


def test_pages_of_one_url_keep_their_own_bodies(spark, tmp_path):
    at = "https://h.example/same"
    same_as_sql(spark, tmp_path, "page_through_cache", [(0, at, "zero"), (3, at, "three"), (4, at, "four"), (6, at, ""), (9, at, None), (7, "https://h.example/7", "seven"), (12, "https://h.example/12", "twelve")])


def test_books_are_packed_and_unpacked_once(spark, tmp_path):
    folder = documents(spark, tmp_path, ["one", "two", "three", "four", "five"])
    got = catalogue.book_titles(spark, folder)
    leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves()
    spark.catalog.clearCache()
    assert {leaves.apply(i).nodeName() for i in range(leaves.size())} == {"InMemoryRelation"}
    assert sorted(tuple(r) for r in got.collect()) == [(0, "Book 0", "src0", 4), (1, "Book 1", "src1", 1)]


def test_python_gets_batches_of_bounded_size(spark, tmp_path):
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(name)
    spark.createDataFrame([(i, "https://h.example/", "x" * 50_000) for i in range(1200)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages = catalogue._t(spark, str(tmp_path), "pages")
    sizes = pages.coalesce(1).mapInPandas(lambda batches: (b[["page_id"]].head(1).assign(page_id=len(b)) for b in batches), "page_id long").collect()
    assert max(r.page_id for r in sizes) <= 500 and max(r.page_id for r in sizes) * 50_000 <= 8 << 20 and sum(r.page_id for r in sizes) == 1200


def test_sections_are_sorted_without_their_texts(spark, tmp_path):
    texts = ["A Synopsis: x", "status: Author: of", "plain " * 2000, ""] * 5
    rows = [(i, x, "src1") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalogue._sections(spark, str(tmp_path)).collect()}
    assert got == {i: ("synopsis", "author:\nstatus:", "", "")[i % 4] for i in range(20)}
    # of the first five sections (titles: none, and then stories or the first episodes), those without a marker stay
    assert {r.doc_id for r in catalogue.section_select(spark, str(tmp_path)).collect()} == {8, 12, 16}


def test_books_are_unpacked_once(spark, tmp_path, monkeypatch):
    """Titles, chapters and warnings of the same books share their members."""
    asked = []
    real = epub.members
    monkeypatch.setattr(epub, "members", lambda archives: asked.append(1) or real(archives))
    got = catalogue.damaged_books(spark, documents(spark, tmp_path, ["one", "two", "three", "four", "five"])).collect()
    assert len(asked) == 1
    assert {r.book: r.n_chapters for r in got} == {0: 4, 1: 1}


def test_a_book_section_is_parsed_once_and_the_texts_are_not_joined_again(spark, tmp_path):
    """Filters that ask for what a section says would be moved below the join, with a second parser of all members."""
    folder = documents(spark, tmp_path, ["one", "", "three\n\n\nfour", "five"])
    for name in ("book_chapters", "book_illustrations"):
        plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [section_of") == 1 and "rangepartitioning" not in plan


def test_illustrations_are_counted_without_the_texts_of_their_sections(spark, tmp_path):
    """What the choice of chapters asks of titles and texts is said where they are parsed; they don't move with their sections."""
    texts = ["one", "two Synopsis: x", "", "four", "Status: five", "six\n\n\n\nsix", "seven", "<img src='../i/3.PNG'/>"]
    out = catalogue.book_illustrations(spark, documents(spark, tmp_path, texts))
    steps = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    moved = [x for x in steps if x.lstrip().split("\n")[0].endswith(" Exchange")]
    sections = [x for x in moved if "image_paths#" in x]
    assert sections and not any(column in x for x in sections for column in ("text#", "title#"))
    # of the first five sections, those with a marker are left out, whichever columns are asked for
    assert sorted((r.book, r.image_index, r.number, r.file) for r in out.collect()) == [
        (0, 1, 1, "001-001.png"), (0, 2, 3, "003-001.png"), (0, 3, 4, "004-001.png"), (1, 1, 2, "002-001.png"), (1, 2, 3, "003-001.png"), (1, 3, 4, "004-001.png"),
    ]
    assert sorted((r.book, r.number) for r in catalogue.book_chapters(spark, str(tmp_path)).collect()) == [(0, 1), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4)]


def test_a_worker_is_handed_few_rows_and_bytes_at_once(spark):
    """However many books one task has."""

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "size": [int(b["content"].map(len).sum())]})

    bounded_batches(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.expr("cast(repeat('x', cast(if(id < 1500, 20000, 10) as int)) as binary)").alias("content"))
    got = rows.mapInPandas(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.n for r in got) == 500 and 1 << 20 < max(r["size"] for r in got) <= (4 << 20) + 20_000


def test_of_members_of_one_name_the_last_counts(spark):
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w") as z:
        warnings.simplefilter("ignore")
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="c.opf"/></container>')
        z.writestr("c.opf", '<package><metadata/><manifest><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        for text in ("early", "late"):
            z.writestr("1.xhtml", f"<h1>Chapter 1</h1>{text}<img src='i.png'/>")
            z.writestr("i.png", text)
    chapters, images, told = epub.import_books(spark.createDataFrame([("a.epub", out.getvalue())], "path string, content binary"))
    assert [r.text for r in chapters.collect()] == ["Chapter 1\n\nlate\n\n[[ILLUSTRATION:001-001.png]]\n"]
    assert [(r.file, bytes(r.data)) for r in images.collect()] == [("001-001.png", b"late")] and not told.collect()
