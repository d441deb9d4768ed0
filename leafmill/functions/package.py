"""Package documents of e-books: a pull parser that gives what a document says, or what is wrong with it, as columns.

Names are read without their namespaces' prefixes. A byte order mark, an encoding declaration and a document type are understood; named entities
that no document type declares are those of HTML. Nothing outside the document is ever read, whatever it refers to.
"""

from __future__ import annotations

import html
import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

ITEM = StructType().add("id", StringType()).add("href", StringType())
PACKAGE = StructType().add("title", StringType()).add("author", StringType()).add("items", ArrayType(ITEM)).add("refs", ArrayType(StringType())).add("error", StringType())


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _parser() -> expat.XMLParserType:
    p = expat.ParserCreate(namespace_separator="}")
    # as if a document type were elsewhere: unknown entities are skipped instead of ending the document; elsewhere is never read
    p.UseForeignDTD(True)
    p.buffer_text = True
    return p


def _run(p: expat.XMLParserType, data: bytes) -> str | None:
    try:
        p.Parse(data.lstrip(b" \t\r\n") if data[:1].isspace() else data, True)
    except expat.ExpatError as e:
        return str(e)
    except (LookupError, ValueError) as e:  # an encoding that nothing knows
        return f"unknown encoding: {e}"
    return None


def container_path(data: bytes | None) -> tuple[str | None, str | None]:
    """(path of the package document, error) of a container document."""
    if data is None:
        return None, "no META-INF/container.xml"
    found: list[str | None] = []
    p = _parser()

    def start(name, attrs):
        if _local(name) == "rootfile":
            found.append(attrs.get("full-path"))

    p.StartElementHandler = start
    if error := _run(p, data):
        return None, f"META-INF/container.xml: {error}"
    if not found:
        return None, "META-INF/container.xml does not declare a rootfile"
    return (found[0], None) if found[0] else (None, "META-INF/container.xml: rootfile without full-path")


class _Reader:
    """One walk over a package document, with the names of the elements that are open."""

    def __init__(self):
        self.open: list[str] = []
        self.metadata = 0  # depth at which the first metadata element is open; -1 when it is over
        self.said: dict[str, str] = {}
        self.taking: list[str] | None = None
        self.items: list[dict] = []
        self.refs: list[str | None] = []

    def start(self, name, attrs):
        name, above = _local(name), self.open[-1] if self.open else None
        self._take()
        self.open.append(name)
        if name == "metadata" and len(self.open) > 1 and not self.metadata:
            self.metadata = len(self.open)
        elif self.metadata > 0 and name in ("title", "creator") and name not in self.said:
            self.taking = []
        if len(self.open) > 2:
            if above == "manifest" and name == "item" and "id" in attrs and "href" in attrs:
                self.items.append({"id": attrs["id"], "href": attrs["href"]})
            elif above == "spine" and name == "itemref":
                self.refs.append(attrs.get("idref"))

    def _take(self):
        """What stood at the start of the element that was open, up to its first child."""
        if self.taking is not None:
            text = re.sub(r"[ \t\r\f\x0b]+", " ", "".join(self.taking)).strip()
            if text:
                self.said[self.open[-1]] = text
            self.taking = None

    def end(self, _):
        self._take()
        if self.metadata == len(self.open):
            self.metadata = -1
        self.open.pop()

    def text(self, data):
        if self.taking is not None:
            self.taking.append(data)

    def entity(self, name, is_parameter):
        if not is_parameter:
            self.text(html.unescape(f"&{name};"))


def package_document(data: bytes | None) -> tuple:
    """(title, author, items, refs, error) of a package document."""
    if data is None:
        return None, None, None, None, "no package document"
    reader, p = _Reader(), _parser()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.SkippedEntityHandler = reader.start, reader.end, reader.text, reader.entity
    if error := _run(p, data):
        return None, None, None, None, f"package document: {error}"
    return reader.said.get("title"), reader.said.get("creator"), reader.items, reader.refs, None


@F.pandas_udf(PACKAGE)
def package_of(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([package_document(x) for x in data], columns=PACKAGE.names)
