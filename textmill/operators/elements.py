"""Parts of encyclopaedia and news pages: an element tree for each page, pruned, and what is read from it."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
#: Elements that end an open paragraph.
BREAKS = frozenset("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element of the key ends an open one of the values.
SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: What is no text of an article; its tags and its classes.
PRUNED_TAGS, PRUNED_CLASSES = frozenset(("table", "script", "style")), frozenset(("mw-editsection", "reference", "reflist", "navbox", "noprint"))
HEADERS = ("h2", "h3", "h4")


class Element:
    __slots__ = ("tag", "id", "classes", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.id, self.classes, self.attributes = tag, attributes.get("id"), frozenset(attributes.get("class", "").split()), attributes
        self.children: list[Element | str] = []
        self.parent = parent

    def walk(self, prune: bool = False) -> Iterator[Element]:
        """The element and those in it, in page order; without what is pruned."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Element) and not (prune and c.pruned())]

    def pruned(self) -> bool:
        return self.tag in PRUNED_TAGS or not PRUNED_CLASSES.isdisjoint(self.classes)

    def pieces(self, dropped: tuple[str, ...] = ()) -> list[str]:
        """The trimmed texts between tags, without empty ones, and without elements of which a class holds one of the words."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out += [x.strip()] if x.strip() else []
            elif x.tag not in RAW and not x.holds(dropped):
                stack += reversed(x.children)
        return out

    def holds(self, words: tuple[str, ...]) -> bool:
        return any(w in c for w in words for c in self.classes)

    def inner(self, dropped: tuple[str, ...] = ()) -> Iterator[Element]:
        """The elements in it, in page order, without those that are dropped."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            x = stack.pop()
            if not x.holds(dropped):
                yield x
                stack += [c for c in reversed(x.children) if isinstance(c, Element)]

    def text(self, prune: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif not (prune and x.pruned()) and x.tag not in RAW:
                stack += reversed(x.children)
        return "".join(out)


def tree(page: str) -> Element:
    """The elements of a page; ends that are missing are put in where HTML puts them, ends of nothing are left out."""
    root = at = Element("", {}, None)
    place, end = 0, len(page)
    while place < end and (m := TOKEN.match(page, place)):
        place = m.end()
        closing, tag, rest = m[1], (m[2] or "").lower(), m[3]
        if not tag:
            if m[0][0] != "<" or len(m[0]) == 1:
                at.children.append(entities.unescape(m[0]))
            continue
        if closing:
            x = at
            while x.parent is not None and x.tag != tag:
                x = x.parent
            at = x.parent or at if x.tag == tag else at
            continue
        ended = ("p",) if tag in BREAKS else SIBLINGS.get(tag, ())
        x = at
        while ended and x.parent is not None and x.tag not in ("table", "ul", "ol", "div", "td") + ended:
            x = x.parent
        if ended and x.tag in ended:
            at = x.parent
        made = Element(tag, {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)}, at)
        at.children.append(made)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, place)
            place = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/"):
            at = made
    return root


PARTS = "title string, categories array<string>, has_body boolean, lead array<string>, paragraphs array<string>, sections array<struct<header:string,paragraphs:array<string>>>"


def parts(page: str | None) -> dict:
    root = tree(page or "")
    every = list(root.walk())
    named = {x.id: x for x in reversed(every) if x.id}
    paragraph = lambda x: x.tag == "p" and x.parent is not None and "mw-parser-output" in x.parent.classes
    title, body, content, links = (named.get(k) for k in ("firstHeading", "bodyContent", "mw-content-text", "mw-normal-catlinks"))
    lists = [x for x in links.walk() if x.tag == "ul"] if links is not None and links.tag == "div" else []
    listed = [x for u in lists for li in u.walk() if li.tag == "li" for x in li.walk() if x.tag == "a"]
    kept = [x for x in content.walk(True) if x is not content] if content is not None else []
    sections = []
    for x in kept:
        if x.tag in HEADERS and "mw-parser-output" in x.parent.classes:
            beside = x.parent.children
            held = []
            for y in beside[next(i for i, y in enumerate(beside) if y is x) + 1 :]:
                if isinstance(y, Element) and y.tag in HEADERS:
                    break
                if isinstance(y, Element) and y.tag == "p" and not y.pruned():
                    held.append(y.text(True))
            sections.append({"header": x.text(True).strip(), "paragraphs": held})
    return {
        "title": title.text().strip() if title is not None else None,
        "categories": [x.text().strip() for x in dict.fromkeys(listed)],
        "has_body": body is not None,
        "lead": [x.text() for x in body.walk() if paragraph(x)][:10] if body is not None else [],
        "paragraphs": [x.text(True) for x in kept if paragraph(x)],
        "sections": sections,
    }


def page_parts(df: DataFrame, html: str, keep: tuple[str, ...]) -> DataFrame:
    """keep with PARTS of each page; a null page is an empty one. Pages are read one at a time, in Arrow blocks."""
    added = T._parse_datatype_string(PARTS)
    keep = tuple(c for c in keep if c not in added.fieldNames())
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    kinds = {"categories": pa.list_(pa.string()), "lead": pa.list_(pa.string()), "paragraphs": pa.list_(pa.string())}
    kinds |= {"title": pa.string(), "has_body": pa.bool_(), "sections": pa.list_(pa.struct([("header", pa.string()), ("paragraphs", pa.list_(pa.string()))]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                block = batch.slice(at, 64)
                made = [parts(x) for x in block.column(len(keep)).to_pylist()]
                arrays = [pa.array([m[f.name] for m in made], kinds[f.name]) for f in added.fields]
                yield pa.RecordBatch.from_arrays([block.column(i) for i in range(len(keep))] + arrays, names=schema.fieldNames())

    return df.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)


class Site(NamedTuple):
    """Where a news site keeps its articles: the class of headlines, of the line with date and author, containers by tag and class, words of classes that are no text."""

    title: str
    byline: str | None
    container: str | None
    containers: tuple[tuple[str, str | None], ...]
    dropped: tuple[str, ...] = ()
    least: int = 0
    author: str | None = None


#: Two news sites.
SITES = {
    "daily": Site(
        "entry-title", None, None, (("div", "body"), ("div", "td-post-content"), ("div", "entry-content"), ("div", "article"), ("article", None)),
        ("tags", "article-card", "post-nav", "related-articles", "adthrive", "card"), author="author",
    ),
    "weekly": Site(
        "article-title", "author datePublished", "article-container",
        (("div", "article-content"), ("div", "entry-content"), ("div", "post-content"), ("div", "article__content"), ("div", "article-body"), ("div", "content"), ("article", None)), least=50,
    ),
}
NEWS = "headline string, published string, author string, content string"


def news(page: str | None, site: Site) -> dict:
    """Headline, date, author and text of a page; null for a part that is not there, but an empty text on a site that asks for no least length.

    Texts between tags are trimmed and joined without blanks, paragraphs by line ends.
    """
    every = list(tree(page or "").inner())
    first = lambda ok: next((x for x in every if ok(x)), None)
    joined = lambda x: "".join(x.pieces())
    head = first(lambda x: x.tag == "h1" and site.title in x.classes) or first(lambda x: x.tag == "h1")
    time = first(lambda x: x.tag == "time")
    meta = lambda name, value: first(lambda x: x.tag == "meta" and x.attributes.get(name) == value)
    published = time.attributes.get("datetime") if time is not None else None
    named = meta("name", "author")
    author = named.attributes.get("content") or None if named is not None else None
    line = first(lambda x: x.tag == "p" and x.attributes.get("class") == site.byline) if site.byline else None
    if line is not None:
        published = author = None
        said = " ".join(line.pieces()).split("by")
        if len(said) >= 2:
            published = said[0].replace("Published", "").strip()
            link = next((x for x in line.inner() if x.tag == "a"), None)
            author = joined(link) if link is not None else None
    elif site.author:
        told = meta("property", "article:published_time")
        published = published if published is not None else told.attributes.get("content") or None if told is not None else None
        beside = first(lambda x: x.tag in ("span", "div") and site.author in " ".join(x.attributes.get("class", "").split()))
        author = author or (joined(beside) if beside is not None else None)

    def body(x: Element) -> str:
        paragraphs = [p for p in x.inner(site.dropped) if p.tag == "p"]
        return "\n".join("".join(p.pieces(site.dropped)) for p in paragraphs) if paragraphs else "\n".join(x.pieces(site.dropped))

    content = None
    own = first(lambda x: x.tag == "div" and x.id == site.container) if site.container else None
    if own is not None:
        content = body(own)
    else:
        for tag, name in site.containers:
            x = first(lambda e: e.tag == tag and (name is None or name in e.classes))  # noqa: B023
            if x is not None:
                content = body(x)
                if len(content) > site.least or not site.least:
                    break
    if content is None and not site.least:
        content = ""
    return {"headline": joined(head) if head is not None else None, "published": published, "author": author, "content": content}


def news_articles(df: DataFrame, html: str, keep: tuple[str, ...], site: Site) -> DataFrame:
    """keep with NEWS of each page, white space in the content collapsed; null where a page has no such part."""
    added = T._parse_datatype_string(NEWS)
    keep = tuple(c for c in keep if c not in added.fieldNames())
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                block = batch.slice(at, 64)
                made = [news(x, site) for x in block.column(len(keep)).to_pylist()]
                arrays = [pa.array([m[f.name] for m in made], pa.string()) for f in added.fields]
                yield pa.RecordBatch.from_arrays([block.column(i) for i in range(len(keep))] + arrays, names=schema.fieldNames())

    made = df.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)
    return made.withColumn("content", F.trim(F.regexp_replace("content", r"(?U)\s+", " ")))
