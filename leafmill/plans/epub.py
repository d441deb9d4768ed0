"""E-books: archive rows to chapters, illustrations and warnings."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BookError
from ..functions.fixed import FRONT_MATTER_NAMES, METADATA_MARKERS
from ..functions.html import section_of
from ..functions.package import container_path, package_of
from ..functions.text import any_of, chapter_number, decode_bytes, illustration_name, is_notice, let, normalize_whitespace
from ..functions.urls import folder_of, norm_path, resource_path, unquoted
from ..session import bounded_batches


#: Bytes of members that are passed on together; a larger member goes by itself.
UNPACKED = 4 << 20
#: What is said of a section by its title, name and text.
JUDGED = ("explicit", "apart", "early")
#: What an archive says of itself.
BOOK = "struct<opf_path: string, error: string, names: array<string>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files with the suffix .epub in any case: path, content. No such file is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]")
    try:
        out = found.load(path).select("path", "content")
        some = out.select("path").take(1)
    except AnalysisException as e:
        raise BookError(f"EPUB file not found: {path}") from e
    if not some:
        raise BookError(f"{path} is not an .epub file, and holds none")
    return out


def members(archives: DataFrame) -> DataFrame:
    """A row per archive member: path, member, data; a file that is no archive gives one row with an error, and so
    does each member that can't be read (encrypted, damaged, of an unknown method). Of members of one name the last counts. An archive with readable
    members ends with a row without a member: book says where its package document is, or why that isn't known, and which members it has; data is that document."""
    shape = ["path", "member", "data", "error", "book"]

    def rows_of(path, content) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            yield path, None, None, f"not an archive: {e}", None
            return
        names, box = [], None
        with archive:
            for name in dict.fromkeys(archive.namelist()):
                try:
                    data = archive.read(name)
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError) as e:
                    yield path, name, None, f"member not readable: {name}: {e}", None
                    continue
                names.append(name)
                if name == "META-INF/container.xml":
                    box = data
                yield path, name, data, None, None
            if names:
                opf_path, error = container_path(box)
                yield path, None, archive.read(opf_path) if opf_path in names else None, None, {"opf_path": opf_path, "error": error, "names": names}

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows_of(path, content):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if len(rows) >= 1000 or held >= UNPACKED:
                        yield pd.DataFrame(rows, columns=shape)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=shape)

    bounded_batches(archives.sparkSession)
    return archives.mapInPandas(unzip, f"path string, member string, data binary, error string, book {BOOK}")


def package_files(parts: DataFrame) -> DataFrame:
    """path, opf_path, package, error, names: the package document of each book as it was read (functions.package), or why there is none, and the members that can be read. A book
    that is broken has an error and takes nothing from the others. Only rows without a member are asked, so no member's bytes move."""
    read = parts.filter("book IS NOT NULL").select("path", "book.*", package_of(F.col("data")).alias("package"))
    return read.select("path", "opf_path", "package", F.coalesce("error", "package.error").alias("error"), "names")


def listed(packages: DataFrame) -> DataFrame:
    """path, member: the members of each book that can be read."""
    return packages.select("path", F.explode("names").alias("member"))


def book_metadata(packages: DataFrame) -> DataFrame:
    """First non-blank title and creator of each book that could be read."""
    return packages.filter("error IS NULL").select("path", "package.title", "package.author")


def spine_join(spine: DataFrame, manifest: DataFrame, book: list[str]) -> DataFrame:
    """Spine entries with their manifest item: of items with one id the last counts, unmatched
    entries go, repeated ones stay. spine: (pos, idref); manifest: (item_pos, id, href)."""
    last = manifest.filter("id <> '' AND href <> ''").groupBy(*book, F.col("id").alias("idref")).agg(F.max_by("href", "item_pos").alias("href"))
    return spine.join(last, [*book, "idref"])


def spine_documents(packages: DataFrame) -> DataFrame:
    """Section documents in reading order: path, pos, source_path, those that the archive has."""
    items = packages.select("path", F.posexplode("package.items").alias("item_pos", "i")).select("path", "item_pos", "i.*")
    refs = packages.select("path", F.posexplode("package.refs").alias("pos", "idref"))
    out = spine_join(refs, items, ["path"]).join(packages.select("path", "opf_path"), "path")
    out = out.withColumn("source_path", norm_path(F.concat(folder_of(F.col("opf_path")), F.lit("/"), unquoted(F.col("href")))))
    have = listed(packages).withColumnRenamed("member", "source_path")
    return out.join(have, ["path", "source_path"], "left_semi").select("path", "pos", "source_path")


def sections(documents: DataFrame, parts: DataFrame, packages: DataFrame) -> DataFrame:
    """Parsed sections with text or images: path, index (from 1), source_path, title, text, image_paths and what `judged` says; marks of missing images go, the others are numbered densely."""
    places = documents.groupBy("path", "source_path").agg(F.collect_list("pos").alias("places"))
    wanted = places.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("source_path", "places"))).alias("wanted"))
    books = wanted.join(packages.select("path", "names"), "path")
    # by the path alone, which is how all that follows is dealt out: a text moves once
    out = books.join(parts.select("path", F.col("member").alias("source_path"), "data"), "path").withColumn("places", F.try_element_at("wanted", F.col("source_path")))
    out = out.filter("places IS NOT NULL").withColumn("s", section_of(decode_bytes(F.col("data")))).drop("data", "wanted")
    out = out.withColumn("refs", F.transform("s.images", lambda r: resource_path(F.col("source_path"), r)))
    out = out.withColumn("keep", F.transform("refs", lambda r: r.isNotNull() & F.coalesce(F.array_contains(F.col("names"), r), F.lit(False))))
    text = marks_renumbered(F.col("s.text"), F.col("keep"))
    out = out.withColumn("text", text).withColumn("image_paths", F.transform(F.filter(F.arrays_zip("refs", "keep"), lambda x: x["keep"]), lambda x: x["refs"]))
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    # what is asked of titles and texts is said before the sections are dealt out, so that texts stay behind where nobody wants them and the patterns aren't left to the few tasks of short rows
    filled = (F.col("text") != "") | (F.size("image_paths") > 0)
    out = judged(out.withColumns({"title": F.coalesce(F.nullif("s.title", F.lit("")), stem), "filled": filled}))
    out = out.select("path", "source_path", "title", "text", "image_paths", "filled", *JUDGED, F.explode("places").alias("pos"))
    # what is empty isn't counted; it goes after the count, since a filter before it would be moved below the parser and parse all members again
    order = Window.partitionBy("path").orderBy("pos")
    out = out.withColumn("index", F.sum(F.col("filled").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return out.filter("filled").select("path", "index", "source_path", "title", "text", "image_paths", *JUDGED)


def marks_renumbered(text: Column, keep: Column) -> Column:
    """Image marks by the running count of kept images; the others removed, blank lines closed."""
    state = F.aggregate(
        keep,
        F.struct(text.alias("t"), F.lit(0).alias("i"), F.lit(0).alias("n")),
        lambda a, k: F.struct(
            F.replace(a["t"], F.concat(F.lit("[[EPUB_IMAGE:"), (a["i"] + 1).cast("string"), F.lit("]]")), F.when(k, F.concat(F.lit("[[EPUB_KEPT:"), (a["n"] + 1).cast("string"), F.lit("]]"))).otherwise("")).alias("t"),
            (a["i"] + 1).alias("i"),
            (a["n"] + k.cast("int")).alias("n"),
        ),
    )
    marked = F.replace(state["t"], F.lit("[[EPUB_KEPT:"), F.lit("[[EPUB_IMAGE:"))
    # a pattern is slow where there is nothing to close
    return F.btrim(let(marked, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)), F.lit("\n"))


def markers_of(text: Column) -> Column:
    """The metadata markers that a text has, a line each: all that `judged` asks of a text, so whole texts needn't move with a book's sections."""
    t = F.lower(text)
    return F.concat_ws("\n", *[F.when(F.contains(t, F.lit(m)), m) for m in METADATA_MARKERS])


def judged(rows: DataFrame) -> DataFrame:
    """rows with what titles, names and texts say of sections: explicit, the number; apart, whether it is front matter, a notice or
    untitled; early, whether it is none of the chapters if it is one of the first five."""
    title = F.col("title")
    t = F.lower(normalize_whitespace(title))
    name = F.lower(F.regexp_extract("source_path", r"[^/]*$", 0))
    apart = (t == "") | is_notice(title) | any_of(t, FRONT_MATTER_NAMES) | any_of(name, FRONT_MATTER_NAMES)
    return rows.withColumns({"explicit": chapter_number(title), "apart": apart, "early": any_of(F.lower("text"), METADATA_MARKERS)})


def select_chapters(rows: DataFrame, book: list[str]) -> DataFrame:
    """Sections with explicit numbers; a book without any takes all that aren't skipped, numbered in order. What `judged` says is taken from rows that have it."""
    out = rows if set(JUDGED) <= set(rows.columns) else judged(rows)
    out = out.filter(~(F.col("apart") | ((F.col("index") <= 5) & F.col("early")))).drop("apart", "early")
    w = Window.partitionBy(*book)
    out = out.withColumn("some", F.max(F.col("explicit").isNotNull()).over(w)).filter(~F.col("some") | F.col("explicit").isNotNull())
    rank = F.row_number().over(w.orderBy("index")).cast("long")
    return out.withColumn("number", F.when(F.col("some"), F.col("explicit")).otherwise(rank)).drop("explicit", "some")


def unique_numbers(chapters: DataFrame, book: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first section of each number, and the others as warnings."""
    w = Window.partitionBy(*book, "number").orderBy("index")
    ranked = chapters.withColumn("__n", F.row_number().over(w))
    return ranked.filter("__n = 1").drop("__n"), ranked.filter("__n > 1").select(*book, F.concat(F.lit("duplicate chapter number "), F.col("number").cast("string"), F.lit(": "), "title").alias("warning"))


def numbered_images(images: DataFrame, book: list[str], number: str, position: str, source: str, order: str | None = None) -> DataFrame:
    """images with n, their count within the chapter `number`, image_index, that within the book (chapters in the order
    of `order`), and the file name that both make."""
    per_chapter = F.row_number().over(Window.partitionBy(*book, number).orderBy(position))
    overall = F.row_number().over(Window.partitionBy(*book).orderBy(order or number, position))
    return images.withColumns({"n": per_chapter, "image_index": overall}).withColumn("file", illustration_name(F.col(number).cast("int"), F.col("n"), F.col(source)))


def opened(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members and package_files of archives, each made once however often it is asked for; a lost executor's are unpacked again."""
    every = members(archives).persist(StorageLevel.DISK_ONLY)
    return every, package_files(every.filter("error IS NULL")).persist(StorageLevel.DISK_ONLY)


def chosen_sections(once: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The sections of what `opened` gave that are chapters: those of `sections` with a number."""
    every, books = once
    return select_chapters(sections(spine_documents(books), every.filter("error IS NULL AND member IS NOT NULL"), books), ["path"])


def chapter_texts(chosen: DataFrame) -> DataFrame:
    """path, number, title, text, file, source_path of the chapters, in no order; marks of images say the images' files. An image's count within
    its chapter is its place among the chapter's images, all of which the book has."""
    kept, _ = unique_numbers(chosen, ["path"])
    files = F.transform("image_paths", lambda source, i: illustration_name(F.col("number").cast("int"), i + 1, source))
    text = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("files"), F.lit(1)) - 1),
        F.col("text"),
        lambda t, i: F.replace(
            t,
            F.concat(F.lit("[[EPUB_IMAGE:"), (i + 1).cast("string"), F.lit("]]")),
            F.coalesce(F.concat(F.lit("[[ILLUSTRATION:"), F.get("files", i), F.lit("]]")), F.lit("")),
        ),
    )
    out = kept.withColumn("files", files).withColumn("text", F.concat(text, F.lit("\n")))
    return out.select("path", "number", "title", "text", F.concat(F.lit("chapter_"), F.col("number").cast("string"), F.lit(".txt")).alias("file"), "source_path")


def chapter_images(chosen: DataFrame) -> DataFrame:
    """path, index, number, source_path, file of the chapters' images, without their bytes."""
    kept, _ = unique_numbers(chosen, ["path"])
    images = kept.select("path", "number", "index", F.posexplode("image_paths").alias("i", "source_path"))
    named = numbered_images(images, ["path"], "number", "i", "source_path", "index")
    return named.select("path", F.col("image_index").alias("index"), "number", "source_path", "file")


def import_books(archives: DataFrame, once: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chapters (path, number, title, text, file, source_path) in order, illustrations (path, index, number, source_path, file, data), warnings.
    `once` is what `opened` gave of the archives, for a caller that asks for it too."""
    every, books = once or opened(archives)
    chosen = chosen_sections((every, books)).persist(StorageLevel.DISK_ONLY)
    _, twice = unique_numbers(chosen, ["path"])
    data = every.filter("error IS NULL AND member IS NOT NULL").select("path", F.col("member").alias("source_path"), "data")
    images = chapter_images(chosen).join(data, ["path", "source_path"]).select("path", "index", "number", "source_path", "file", "data")
    broken = every.filter("error IS NOT NULL").select("path", F.col("error").alias("warning"))
    none = books.filter("error IS NOT NULL").select("path", F.col("error").alias("warning"))
    unread = books.filter("error IS NULL").join(spine_documents(books).select("path").distinct(), "path", "left_anti").select("path", F.lit("no readable documents in the spine").alias("warning"))
    return chapter_texts(chosen).orderBy("path", "number"), images, twice.unionByName(broken).unionByName(none).unionByName(unread)
