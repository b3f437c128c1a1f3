"""Articles and links of HTML pages by patterns, tables by a parser, and breadth-first link walks."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from textmill.functions.text import collapse_blanks


def untagged(html: Column) -> Column:
    x = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return collapse_blanks(x)


def first_match(html: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def article(html: Column) -> Column:
    """struct(title, date, author, body) with fallbacks for each."""
    title = untagged(first_match(html, r'(?is)<h1 class="entry-title"[^>]*>(.*?)</h1>', r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title>(.*?)</title>"))
    date = first_match(html, r'(?i)<time[^>]*datetime="([^"]*)"', r'(?i)<meta[^>]*article:published_time"[^>]*content="([^"]*)"')
    author = first_match(html, r'(?i)<meta[^>]*name="author"[^>]*content="([^"]*)"', r'(?is)class="[^"]*author[^"]*"[^>]*>(.*?)<')
    inner = first_match(html, r'(?is)<div class="entry-content"[^>]*>(.*?)</div>', r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<main[^>]*>(.*?)</main>", r"(?is)<body[^>]*>(.*)")
    body = F.array_join(F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), untagged), lambda x: x != ""), " ")
    return F.struct(title.alias("title"), date.alias("date"), author.alias("author"), body.alias("body"))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\b[^>]*href="([^"]*)"'), F.lit(1)))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


@udtf(returnType="row int, cells map<string,string>")
class TableRows:
    """Rows of the first table with five columns or more, over one row and five filled cells in its first row, which names the columns."""

    def eval(self, html: str):
        parser = _Tables()
        parser.feed(html or "")
        for table in parser.tables:
            if len(table) > 1 and len(table[0]) >= 5 and sum(bool(c) for c in table[0]) >= 5:
                for i, cells in enumerate(table[1:]):
                    yield i, dict(zip(table[0], cells))
                return


def walk_links(edges: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """(node, depth) of what is reached from ``start`` over edges (src, dst) in at most ``most`` steps, each node at its least depth.

    Each step joins only the newest nodes and drops those seen before; steps are cut by checkpoints.
    """
    from textmill.operators.lineage import cut

    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for depth in range(1, most + 1):
        reached = edges.join(newest.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        newest = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        seen = seen.union(newest)
    return seen
