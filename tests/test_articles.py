"""Pages as pruned trees, rules of articles, and objects in answers, against values worked out by hand and plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import json_text, maritime
from textmill.functions import text as fx
from textmill.operators import elements, encyclopaedia
from textmill.plans import article_queries

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body>
<h1 id="firstHeading"> Port of <i>Nowhere</i> </h1><div id="bodyContent"><div id="mw-content-text"><div class="a mw-parser-output">
<table><tr><td><p>cell</p><table><tr><td>inner</table></table>
<p>One &amp; two<sup class="reference">[1]</sup>.<style>p{}</style></p><p>Second<span class="x noprint">gone <b>too</b></span> one
<div class="navbox"><p>box</p><div><p>deeper</p></div></div>
<div><p>not a child</p></div>
<h2>History<span class="mw-editsection">[edit]</span></h2><p>Third</p><ul><li>item<li>item</ul><p class="reflist">gone</p><p>Fourth</p>
<h3>References</h3><p>Fifth</p><h2 class="noprint">Gone</h2><h4></h4><p>Sixth</p></div></div></div>
<div id="mw-normal-catlinks"><a>Categories</a><ul><li><a href="/c">Ships</a></li><li><a>Old <b>ports</b></a></ul></div></body></html>"""


def test_parts():
    got = elements.parts(PAGE)
    assert got["title"] == "Port of Nowhere" and got["categories"] == ["Ships", "Old ports"] and got["has_body"]
    assert got["lead"][0] == "One & two[1]." and [x.strip() for x in got["lead"][1:]] == ["Secondgone too one", "Third", "gone", "Fourth", "Fifth", "Sixth"]
    assert [x.strip() for x in got["paragraphs"]] == ["One & two.", "Second one", "Third", "Fourth", "Fifth", "Sixth"]
    assert got["sections"] == [{"header": "History", "paragraphs": ["Third", "Fourth"]}, {"header": "References", "paragraphs": ["Fifth"]}, {"header": "", "paragraphs": ["Sixth"]}]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></div>", "<p><p><p>", "<script>", "<div id=bodyContent", "<!-- ", "a < b > c", "<a href='x>y</a>", "<li><li></ul>", "<div " * 3000])
def test_broken_pages(page):
    assert elements.parts(page)["paragraphs"] == []


def test_deep_pages():
    deep = "<div class='mw-parser-output'>" * 20_000 + "<p>x</p>"
    assert elements.parts(f"<div id='mw-content-text'>{deep}")["paragraphs"] == ["x"]


TERMS = encyclopaedia.Terms(("laytime",), ("suez canal",), ("cargo",), ("doctor", "clinical"))


def page(title, lead, category="Things", body=True):
    inner = "".join(f"<p>{p}</p>" for p in lead)
    return f"<h1 id='firstHeading'>{title}</h1><div id='{'bodyContent' if body else 'other'}'><div id='mw-content-text'><div class='mw-parser-output'>{inner}</div></div></div><div id='mw-normal-catlinks'><ul><li><a>{category}</a></li></ul></div>"


def test_rules(spark):
    filler = "word " * 300
    rows = {
        "title": (page("A Tanker", [filler]), "/x", 0.7), "place": (page("Port of X", [filler]), "/x", 0.8), "category": (page("Y", [filler], "Old ships"), "/x", 0.5),
        "nothing": (page("Y", [filler, "cargo " * 9]), "/x", None), "lead": (page("Y", ["laytime " * 3]), "/x", 3 * 3 / 103 * 20), "late": (page("Y", [filler, filler, filler, "laytime " * 40]), "/x", 1.0),
        "too late": (page("Y", [filler] * 10 + ["laytime " * 40]), "/x", None), "blocked": (page("A Tanker", [filler], "Cruise ships"), "/x", None), "no body": (page("A Tanker", [filler], body=False), "/x", None),
        "address": (page("Y", [f"{filler} laytime"]), "/Port_x", 3 / 401 * 20), "vetoed": (page("Y", ["laytime laytime doctor clinical"]), "/x", None),
        "empty": ("", "/x", None), "null": (None, None, None),
    }
    df = spark.createDataFrame([(k, h, u, 1) for k, (h, u, _) in rows.items()], "k string, html string, url string, title int")
    got = {r.k: r.relevance for r in encyclopaedia.articles(df, "html", "url", ("k",), TERMS, ("Category:Cruise_ships",)).collect()}
    assert got.keys() == {k for k, (*_, want) in rows.items() if want is not None}
    assert all(got[k] == pytest.approx(min(1.0, rows[k][2])) for k in got)
    kept = encyclopaedia.corpus(encyclopaedia.articles(df, "html", "url", ("k",), TERMS), 0.6).collect()
    assert [r.relevance for r in kept] == sorted((r.relevance for r in kept), reverse=True) and len(kept) == 5


def plain_object(text):
    begin = (text or "").find("{")
    depth, inside, i = 0, False, begin
    while 0 <= i < len(text or ""):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            inside = not inside
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : i + 1]
        i += 1
    return None


def test_first_object(spark):
    rng = random.Random(5)
    texts = [None, "", "no object", "{", "}{", '{"a": "}"}', '{"a": "\\"}"} {"b": 1}', 'x {"a": {"b": {}}} y } {', '{"a": "' + "long \\n" * 20_000 + '"} tail', "\U0001f600{\U0001f600}é{", "{'it''s': 1}"]
    texts += ["".join(rng.choice(["{", "}", '"', "\\", "a", "\n", ":", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    got = {r.id: r.o for r in df.select("id", json_text.first_object("t").alias("o")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, plain_object(t)) for t in texts]


def test_answers(spark):
    inner = json.dumps({"a": "}", "b": {"c": [1, 2]}})
    said = {"plain": inner, "wrapped": f"'\"' {inner} '\"'", "fence": f"```json\n{inner}\n```", "thought": f"<think>{{no}}</think> 好的 {inner} and {{}}", "none": "'\"'", "null": None, "one": '"'}
    df = spark.createDataFrame(list(said.items()), "k string, t string")
    got = {r.k: r.o for r in df.select("k", json_text.answer_object("t").alias("o")).collect()}
    assert got == {"plain": inner, "wrapped": inner, "fence": inner, "thought": inner, "none": None, "null": None, "one": None}
    peeled = {r.k: r.p for r in df.select("k", json_text.peeled(F.col("t")).alias("p")).collect()}
    assert peeled["none"] == '"' and peeled["one"] == '"' and peeled["null"] is None


def plain_count(text, patterns):
    return sum(len(list(re.finditer(p, text, re.I))) for p in patterns)


def plain_valid(s):
    bad = any(re.search(p, s, re.I) for p in maritime.STRUCTURE + maritime.BAD)
    return len(s.split()) >= 3 and not bad and re.search(r"[a-zA-Z]{3,}", s) is not None


SENTENCES = [
    "A ship sails on.", "Two words", "See also the list of ports", "12 34 56 7", "aaaaaaaaaaaaaaaa is long", "Odd ##### signs here", "short one", "The vessel, of 5,000 TEU, left Rotterdam.", "1. 2. 3.", "…………… and more of it",
    "Ünï ünï ünï ünï", "", "This  page\nis an example text", "a b c d e f g h i j k l m", "Berth and harbour (no. 4) - all of them!",
]


def test_sentences_of_the_domain(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, s string")
    got = {r.id: r.v for r in df.select("id", maritime.valid_sentence(F.col("s")).alias("v")).collect()}
    assert [(s, got[i]) for i, s in enumerate(SENTENCES)] == [(s, plain_valid(s)) for s in SENTENCES]


def test_scores_of_the_domain(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text, r.s) for r in article_queries.with_phrases(spark, sf).select("doc_id", "text", fx.protected_sentences("text").alias("s")).collect()}
    got = article_queries.maritime_scores(spark, sf).collect()
    assert len(got) == len(texts) and len({r.rejection for r in got}) >= 4 and sum(r.relevance > 0 for r in got) > 50
    for r in got:
        text, sentences = texts[r.doc_id]
        n = len(text.split())
        total = sum(plain_count(text, ps) * (2 if k in maritime.TWICE else 1) for k, ps in maritime.DOMAIN.items())
        relevance = total / n if n else 0.0
        quality = (plain_count(text, maritime.GOOD) - plain_count(text, maritime.BAD)) / n if n else -1.0
        good = sum(map(plain_valid, sentences))
        rules = (
            (len(text) < 50, "too_short"), (len(text) > 8192, "too_long"), (n < 10, "too_few_words"), (n > 1200, "too_many_words"), (good < 2, "too_few_sentences"),
            (relevance < 0.005, "not_maritime_relevant"), (quality < -0.02, "low_quality"),
        )
        want = next((name for failed, name in rules if failed), None)
        assert (r.relevance, r.quality, r.sentences, r.rejection) == (pytest.approx(relevance, abs=1e-6), pytest.approx(quality, abs=1e-6), good, want), text[:200]


def test_news_of_two_sites(spark):
    daily, weekly = elements.SITES["daily"], elements.SITES["weekly"]
    page = "<h1>A <i>b</i></h1><p class='author datePublished'>Published May 3, 2024 by <a> The Desk </a></p><div id='article-container'><p>One</p> stray <div><p> Two </p></div></div>"
    assert elements.news(page, weekly) == {"headline": "Ab", "published": "May 3, 2024", "author": "The Desk", "content": "One\nTwo"}
    long = "x" * 60
    page = f"<meta name=author content=Me><time datetime=2024>t</time><h1 class='article-title'>T</h1><div class='entry-content'>short</div><div class='content'><b>{long}</b> end</div>"
    assert elements.news(page, weekly) == {"headline": "T", "published": "2024", "author": "Me", "content": f"{long}\nend"}
    assert elements.news(page, daily)["content"] == "short"
    assert elements.news("<div class='body'>a <p class='cards'>b</p></div><div class='authors'>Z</div>", daily) == {"headline": None, "published": None, "author": "Z", "content": "a"}
    for broken in (None, "", "<", "<h1", "<p class='author datePublished'>no date</p>"):
        assert elements.news(broken, weekly)["content"] is None and elements.news(broken, daily)["published"] is None
    df = spark.createDataFrame([(1, "<article><p>a\u00a0 b</p>\n<p>c</p></article>", "x"), (2, None, "y")], "k int, html string, headline string")
    assert [(r.k, r.content) for r in elements.news_articles(df, "html", ("k", "headline"), daily).orderBy("k").collect()] == [(1, "a b c"), (2, "")]


def test_patterns_of_the_domain_are_matched_once(spark):
    plan = article_queries.maritime_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("suezmax") == 1 and plan.count("lorem") == 2  # once for the text, once for its sentences
