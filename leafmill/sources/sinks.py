"""Sinks: chapter files, JSON documents, images, caches. All can be run again with the same outcome."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

JSON = {"pretty": "true", "ignoreNullFields": "false"}


FILES = "leafmill_files"


@dataclass
class _Staged(WriterCommitMessage):
    """A task's list of what it has written: a file of lines (size, temporary name, own name)."""

    listed: str


class _FileWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; the driver's commit gives the files their names. A job that fails, and an attempt that another
    outruns, leave nothing but what abort or the commit takes away."""

    def __init__(self, root: str):
        self.root, self.job = root, os.path.join(root, f".files-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> _Staged:
        own = os.path.join(self.job, uuid.uuid4().hex)
        os.makedirs(own)
        listed = os.path.join(own, "list")
        with open(listed, "w", encoding="utf-8") as names:
            for n, row in enumerate(rows):
                to = os.path.normpath(os.path.join(self.root, row.path))
                if os.path.relpath(to, self.root).startswith(".."):
                    raise ValueError(f"a file outside {self.root}: {row.path}")
                data = bytes(row.content)
                part = os.path.join(own, str(n))
                with open(part, "wb") as f:
                    f.write(data)
                names.write(json.dumps([len(data), part, to]) + "\n")
        return _Staged(listed)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None:
                with open(m.listed, encoding="utf-8") as names:
                    for line in names:
                        _, part, to = json.loads(line)
                        os.makedirs(os.path.dirname(to), exist_ok=True)
                        os.replace(part, to)
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class NamedFiles(DataSource):
    """`df.write.format("leafmill_files").option("root", folder)`: rows (path, content) as files with exact names."""

    @classmethod
    def name(cls):
        return FILES

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite: bool):
        return _FileWriter(os.path.abspath(self.options["root"]))


def write_named_files(rows: DataFrame, root: str) -> None:
    """Write (path, content) as files with exact names below root, which is on a file system that all executors share: all of them or, where the job fails, none. A file
    that exists is whole at any time; of rows with one path any one stays. Null contents are left out."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    out = rows.filter("content IS NOT NULL").select("path", F.col("content").cast("binary").alias("content"))
    out.write.format(FILES).mode("append").option("root", root).save()


def write_chapters(rows: DataFrame, path: str, keep_existing: bool = False) -> None:
    """(slug, number, content) as Parquet by slug; only the slugs in rows are replaced, or nothing if existing ones are kept."""
    out = rows.write.partitionBy("slug").option("partitionOverwriteMode", "dynamic")
    out.mode("append" if keep_existing else "overwrite").parquet(path)


def json_text(*columns: str) -> Column:
    """Columns as pretty JSON text that keeps nulls."""
    return F.to_json(F.struct(*columns), JSON)


def metadata_json(rows: DataFrame) -> DataFrame:
    """rows with `content`: title, translated, author, source_url, illustration_url, site_name, in this order."""
    translated = F.struct(F.lit(None).cast("string").alias("en"), F.lit(None).cast("string").alias("vi")).alias("translated")
    return rows.withColumn("content", F.to_json(F.struct("title", translated, "author", "source_url", "illustration_url", "site_name"), JSON))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache (key, body) with new bodies in place of old ones."""
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "body"))


def cache_drop(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")
