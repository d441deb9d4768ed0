"""Markup to columns: built-in expressions for flat markup, one parsing function for nested markup."""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from .fixed import BLOCK_TAGS, HEADINGS, SKELETON_ATTRS, SKELETON_DROP, SKIP_TAGS
from .selectors import Index, compiled, fault
from .text import lines, normalize_text, unescaped

NODE = StructType().add("pos", IntegerType()).add("tag", StringType()).add("attrs", MapType(StringType(), StringType())).add("text", StringType())
#: The names of references, by their first letters.
_NAMES = "|".join(f"{a}(?:{'|'.join(sorted(n[1:-1] for n in html5 if n[0] == a and n[-1] == ';'))})" for a in sorted({n[0] for n in html5}))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def first_tag(page: Column, tag: str) -> Column:
    """Inner markup of a page's first such element; null if there is none."""
    return F.when(page.rlike(rf"(?is)<{tag}[\s>]"), F.regexp_extract(page, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def closed_references(page: Column) -> Column:
    """A page in which only references that end in a semicolon are any: every other ampersand is written out as one. HTML's own reading, which everything
    here has by default, also takes `&amp` without its end for one."""
    return F.regexp_replace(page, rf"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|{_NAMES});)", "&amp;")


def without(page: Column, *patterns: str) -> Column:
    for p in patterns:
        page = F.regexp_replace(page, p, "")
    return page


def flat_node(tag: str, attr: str = "") -> str:
    """Pattern of an element that holds none of its own kind."""
    return rf"(?is)<{tag}(?:\s[^>]*)?{attr}[^>]*>.*?</{tag}>"


def plain_text(markup: Column) -> Column:
    """Every text node on lines of its own, lines normalised, blank ones dropped."""
    x = markup
    for dropped in (flat_node("script"), flat_node("style"), flat_node("noscript"), r"(?s)<!--.*?-->"):
        x = F.regexp_replace(x, dropped, "\n")  # the texts on its sides stay apart
    x = unescaped(F.regexp_replace(x, r"(?s)<[^>]+>", "\n"))
    return F.array_join(F.filter(F.transform(lines(x), normalize_text), lambda v: v != ""), "\n")


def inner_text(markup: Column) -> Column:
    return unescaped(F.regexp_replace(markup, r"(?s)<[^>]+>", ""))


def anchors(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with pos, href and link_text for each anchor that has a non-empty href."""
    found = F.regexp_extract_all(F.col(page), F.lit(r"(?is)(<a\s[^>]*>.*?)</a>"), 1)
    out = pages.select("*", F.posexplode(found).alias("pos", "__a"))
    # the value in quotes of either kind, or up to white space
    held = [F.regexp_extract("__a", rf"(?is)^<a\s(?:[^>]*?[\s\"'])?href\s*=\s*{v}", 1) for v in (r"\"([^\"]*)\"", r"'([^']*)'", r"([^\s\"'>]+)")]
    out = out.withColumn("href", unescaped(F.concat(*held)))
    return out.withColumn("link_text", normalize_text(inner_text(F.regexp_replace("__a", r"(?s)^<[^>]*>", "")))).filter("href <> ''").drop("__a")


class _Tree(HTMLParser):
    """Elements as [tag, attributes, parent, children], in document order; texts are strings."""

    def __init__(self, strays: bool = False):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, None, []]
        self.at, self.every = self.root, []
        self.index: Index | None = None
        self.strays = strays

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, self.at, []]
        self.at[3].append(node)
        self.every.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at[2]

    def handle_endtag(self, tag):
        node = self.at
        while node[2] is not None and node[0] != tag:
            node = node[2]
        if node[2] is not None:
            self.at = node[2]
        elif self.strays:  # nothing is open that it closes; its place is kept by an empty element
            self.at[3].append([tag, {}, self.at, []])

    def handle_data(self, data):
        self.at[3].append(data)


def parsed(page: str, strays: bool = False) -> _Tree:
    tree = _Tree(strays)
    tree.feed(page)
    tree.close()
    return tree


def _texts(node) -> list[str]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n[3]))
    return out


def select(tree: _Tree, selector: str) -> list:
    """Nodes of a selector list, in document order; a text that is no selector is a SelectorError."""
    chains = compiled(selector)
    if tree.index is None:
        tree.index = Index(tree.every)
    return tree.index.select(chains)


def _found(tree: _Tree, selector: str | None) -> list[dict] | None:
    """Matches as rows; None for no selector and for a text that is none."""
    if selector is None or fault(selector):
        return None
    return [{"pos": i, "tag": n[0], "attrs": n[1], "text": "".join(_texts(n))} for i, n in enumerate(select(tree, selector))]


@F.pandas_udf(StringType())
def selector_fault(selector: pd.Series) -> pd.Series:
    """What is wrong with a selector, null if nothing."""
    return selector.map(fault, na_action="ignore").astype(object)


@F.pandas_udf(ArrayType(NODE))
def css_select(page: pd.Series, selector: pd.Series) -> pd.Series:
    """All matches of a selector (functions.selectors); null for a null page, a null selector and one that isn't understood (`selector_fault` says why)."""
    return pd.Series([None if p is None or s is None else _found(parsed(p), s) for p, s in zip(page, selector)], dtype=object)


def css_select_all(page: Column, selectors: list[str | None]) -> Column:
    """An array with the matches of each selector, null for a null one and one that isn't understood; a page is parsed once."""

    @F.pandas_udf(ArrayType(ArrayType(NODE)))
    def run(pages: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            tree = parsed(p)
            return [_found(tree, s) for s in selectors]

        return pages.map(one)

    return run(page)


def _one_space(x: str) -> str:
    """Runs of blanks as one; by replacing texts, since most blanks stand alone and a pattern would stop at each."""
    for blank in "\t\r\f\x0b":
        x = x.replace(blank, " ")
    while "  " in x:
        x = x.replace("  ", " ")
    return x.strip()


def _said(text: str) -> str:
    """A text node of a book as it is read: entities that were escaped twice, and breaks written out as text."""
    return re.sub(r"(?i)<\s*br\s*/?\s*>", "\n", html.unescape(text))


def _image_source(node) -> str | None:
    if node[0] not in ("img", "image"):
        return None
    return next((html.unescape(node[1][k]) for k in ("src", "href", "xlink:href") if node[1].get(k)), None)


def parse_section(markup: str) -> tuple[str, str, list[str]]:
    """(title, text, image sources) of a book section: one walk over its tree. Blocks and images stand on lines of their own,
    an image as a numbered mark; the title is the first heading that has a text."""
    flow: list[str] = []
    images: list[str] = []
    titles: list[str] = []
    todo: list = [parsed(markup, strays=True).root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # the far edge of a block
            flow.append(node[0])
        elif isinstance(node, str):
            flow += [x for x in [_said(node)] if x.strip()]
        elif node[0] not in SKIP_TAGS:
            edge = "\n" if node[0] in BLOCK_TAGS else ""
            flow.append(edge)
            if source := _image_source(node):
                images.append(source)
                flow.append(f"\n[[EPUB_IMAGE:{len(images)}]]\n")
            if node[0] in HEADINGS:
                titles.append(_one_space(" ".join(x for x in map(_said, _texts(node)) if x.strip())))
            todo.append((edge,))
            todo.extend(reversed(node[3]))
    lines_of = map(_one_space, "".join(flow).splitlines())
    return next(filter(None, titles), ""), "\n\n".join(filter(None, lines_of)), images


@F.pandas_udf(StructType().add("title", StringType()).add("text", StringType()).add("images", ArrayType(StringType())))
def section_of(markup: pd.Series) -> pd.DataFrame:
    """Title, text and image sources of a book section."""
    rows = [parse_section(m or "") for m in markup]
    return pd.DataFrame({"title": [r[0] for r in rows], "text": [r[1] for r in rows], "images": [r[2] for r in rows]})


def skeleton_text(page: str, most: int = 30_000) -> str:
    """Structure of a page: noise dropped, few attributes kept, long texts cut, one node a line."""
    out: list[str] = []
    todo: list = [(x, 0) for x in reversed(parsed(page).root[3])]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            if t := node.strip():
                out.append(" " * depth + html.escape(t[:40] + "…" if len(t) > 80 else t, quote=False))
        elif isinstance(node, tuple):  # an end tag
            out.append(node[0])
        elif node[0] not in SKELETON_DROP:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in node[1].items() if k in SKELETON_ATTRS)
            out.append(" " * depth + f"<{node[0]}{attrs}{'/' if node[0] in VOID else ''}>")
            if node[0] not in VOID:
                todo.append(((" " * depth + f"</{node[0]}>",), depth))
            todo.extend((x, depth + 1) for x in reversed(node[3]))
    text = "\n".join(out) + "\n"
    return text if len(text) <= most else text[:most] + "\n<!-- truncated -->"


@F.pandas_udf(StringType())
def skeleton(page: pd.Series) -> pd.Series:
    return page.map(lambda p: None if p is None else skeleton_text(p))


def _live(tree: _Tree) -> None:
    """Take the nodes that still hang on the root as the tree's nodes."""
    out, todo = [], [tree.root]
    while todo:
        n = todo.pop()
        if n is not tree.root:
            out.append(n)
        todo.extend(x for x in reversed(n[3]) if not isinstance(x, str))
    tree.every, tree.index = out, None


def _separate_texts(node) -> list[str]:
    """Text nodes of an element; those that touch are one, a break is a newline, code is left out."""
    out: list[str] = []
    touching = False
    todo: list = list(reversed(node[3]))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if touching:
                out[-1] += n
            else:
                out.append(n)
            touching = True
            continue
        touching = False
        if isinstance(n, list) and n[0] == "br":
            out.append("\n")
        elif isinstance(n, list) and n[0] not in ("script", "style", "noscript"):
            todo.append(())  # its end keeps the texts on both sides apart
            todo.extend(reversed(n[3]))
    return out


def chapter_of(page: str, content: str, title: str | None, remove: list[str]) -> tuple[str | None, str | None, str | None]:
    """Title (before removals), plain text and error of a page by selectors; None for a node that isn't there."""
    if wrong := next(filter(None, map(fault, [content, title, *remove])), None):
        return None, None, wrong
    tree = parsed(page)
    head = select(tree, title)[:1] if title else []
    name = re.sub(r"[ \t\r\f\x0b]+", " ", " ".join("".join(_texts(n)) for n in head).replace("\xa0", " ")).strip() or None
    for one in remove:
        gone = {id(n) for n in select(tree, one)}
        for n in select(tree, one):
            if any(id(x) in gone for x in n[2][3]):
                n[2][3] = [x for x in n[2][3] if id(x) not in gone]
        _live(tree)
    body = select(tree, content)[:1]
    if not body:
        return name, None, None
    found = (re.sub(r"[ \t\r\f\x0b]+", " ", x.replace("\xa0", " ")).strip() for x in "\n".join(_separate_texts(body[0])).splitlines())
    return name, "\n".join(x for x in found if x), None


def chapters_of(page: Column, content: str, title: str | None, remove: list[str]) -> Column:
    """A struct (title, body, error) by any selectors; error says which of them isn't understood. `plans.crawl.extract_chapter` does flat markup without leaving the JVM."""

    @F.pandas_udf(StructType().add("title", StringType()).add("body", StringType()).add("error", StringType()))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chapter_of(p or "", content, title, remove) for p in pages], columns=["title", "body", "error"], dtype=object)

    return run(page)
