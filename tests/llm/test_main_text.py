"""Main text: what stands in an article and is no part of it, hidden elements, and blocks against a second reader of pages."""

from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from textmill.llm import htmltext

SF = "/root/testdata/sf0.01"
PROSE = "The committee met again on Monday, and after a long debate it agreed to postpone the vote. Members said that they needed more time to read the report."
LONG = "I read this with some interest, but cannot agree with it at all; the facts are other than the author says. Perhaps they should look again, and more closely this time."
AROUND = {
    "section comments": '<section class="comments">{}</section>', "div id comments": '<div id="comments">{}</div>', "aside": "<aside>{}</aside>", "footer": "<footer>{}</footer>",
    "advert": '<div class="advert">{}</div>', "newsletter": '<div class="newsletter">{}</div>', "form": "<form>{}</form>", "complementary": '<div role="complementary">{}</div>',
    "no display": '<div style="color:red; display : none">{}</div>', "hidden": "<div hidden>{}</div>", "nav": "<nav>{}</nav>", "comment list": '<ol class="commentlist"><li>{}</li></ol>',
    "aside with a body": '<aside><div class="body">{}</div></aside>', "related": '<div class="related-posts">{}</div>', "comment as article": '<div class="comments"><article>{}</article></div>',
}
INNER = {"two paragraphs": f"<p>{LONG}</p><p>{LONG}</p>", "short paragraph": "<p>Sign up now.</p>", "bare": LONG, "bare and short": "Sign up now.", "many": f"<p>{LONG}</p>" * 8}


@pytest.fixture(scope="module", params=["invented pages alone", "with given pages"])
def model(request):
    pages = [r["html"] or "" for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()] if request.param.startswith("with") else []
    return htmltext.train(pages)


@pytest.mark.parametrize("name", AROUND)
def test_no_part_of_an_article(model, name):
    for inner in INNER.values():
        for place in (0, 1, 3, 7):  # before the heading, after it, in the middle, at the end
            for outer in ("article", "main", "article class='post'"):
                parts = ["<h1>A heading of it</h1>", *[f"<p>{i} {PROSE}</p>" for i in range(4)], "<ul><li>An item of a list, of some length.</li><li>And another one.</li></ul>", f"<p>Last. {PROSE}</p>"]
                parts.insert(place, AROUND[name].format(inner))
                page = f"<title>T</title><nav><a href=/>Home</a></nav><{outer}>{''.join(parts)}</{outer.split()[0]}><footer>Imprint</footer>"
                want = ["A heading of it", *[f"{i} {PROSE}" for i in range(4)], "An item of a list, of some length.", "And another one.", f"Last. {PROSE}"]
                assert htmltext.main_text(page, model)[0].split("\n") == want, (inner, place, outer)


def test_an_article_within_something_else(model):
    article = f"<article><h1>Heading</h1><p>{PROSE}</p><p>{LONG}</p></article>"
    for page in (f"<form id=page>{article}</form>", f'<div class="page has-sidebar">{article}</div>', f"<div class=wrap>{article}</div>"):
        assert htmltext.main_text(page, model)[0] == f"Heading\n{PROSE}\n{LONG}"
    beside = f"<article><h1>Heading</h1><p>{PROSE}</p></article><aside><article><p>{LONG}</p></article></aside>"
    assert htmltext.main_text(beside, model)[0] == f"Heading\n{PROSE}"


def test_hidden_text_is_none():
    texts = lambda page: [b.text for b in htmltext.read_blocks(page)]
    assert texts('<p>a <span style="display:none">b <span>c</span> d</span> e</p>') == ["a e"]
    assert texts("<p>a <span hidden>b</p><p>c</p>") == ["a", "c"]
    assert texts('<div hidden=""><p>a</p><div>b</div></div><p>c</p>') == ["c"]
    assert texts('<p data-hidden="x" title="hidden style">a <img hidden> b</p><p hidden/>c') == ["a b", "c"]
    assert texts("<p style='display:block'>a <i hidden/> b</p>") == ["a b"]


class Plain(HTMLParser):
    """The texts of blocks: a second reader, over another parser."""

    SKIPPED = frozenset("script style noscript template svg iframe object textarea select button".split())

    def __init__(self):
        super().__init__()
        self.out, self.held, self.open, self.skip, self.hush = [], [], [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.out += [text] if text else []
        self.held = []

    def hides(self, attrs):
        return any(k == "hidden" or k == "style" and "display:none" in (v or "").replace(" ", "") for k, v in attrs)

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in self.SKIPPED:
            self.skip += [tag] if not self.skip or tag == self.skip[0] else []
            return
        if tag not in htmltext.BLOCKS:
            if self.hush:
                self.hush += [tag] if tag == self.hush[0] else []
            elif self.hides(attrs) and tag not in htmltext.INLINE_VOID:
                self.hush = [tag]
            elif tag == "br":
                self.held.append(" ")
            return
        self.flush()
        for ended in htmltext.CLOSES.get(tag, ()):
            for i in reversed(range(len(self.open))):
                if self.open[i][0] == ended:
                    del self.open[i:]
                    self.hush = []
                    break
                if self.open[i][0] in htmltext.SCOPES:
                    break
        if tag != "hr":
            self.open.append((tag, self.hides(attrs) or bool(self.open) and self.open[-1][1]))

    def handle_startendtag(self, tag, attrs):
        if tag in htmltext.BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        if tag not in htmltext.BLOCKS:
            if self.hush and tag == self.hush[0]:
                self.hush.pop()
            return
        self.flush()
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                del self.open[i:]
                self.hush = []
                break

    def handle_data(self, data):
        if not self.skip and not self.hush and not (self.open and self.open[-1][1]):
            self.held.append(data)


def plain_blocks(page):
    reader = Plain()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def test_blocks_as_a_second_reader_finds_them():
    pages = [r["html"] or "" for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    pages += [f"<body>{AROUND[a].format(INNER[i])}<p>x &amp; y &eacute;<br>z<p>next<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>" for a in AROUND for i in INNER]
    assert sum(len(htmltext.read_blocks(p)) for p in pages) > 4000
    for page in pages:
        assert [b.text for b in htmltext.read_blocks(page)] == plain_blocks(page)
