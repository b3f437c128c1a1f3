"""Queries on encyclopaedia articles and on objects in the answers of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import articles as cleaning
from textmill.functions import json_text, maritime
from textmill.functions import text as fx
from textmill.operators import elements, encyclopaedia, labels
from textmill.plans.quality_queries import ENTITY, PRIMARY, SECONDARY, VETO, WORDS, terms_sql
from textmill.plans.registry import query
from textmill.sources.tables import spread, table

#: What is put behind each text, and its normal form KC.
MARKUP = " [3] ﬁn ½ ② (verify) &amp; <b>x</b> 21°42′N 72°32′E / Dahej [[Port of X|the port]] «q»​{{cite}}"
NORMAL_MARKUP = " [3] fin 1⁄2 2 (verify) &amp; <b>x</b> 21°42′N 72°32′E / Dahej [[Port of X|the port]] «q»​{{cite}}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_sql(text: str) -> str:
    x = text
    for pattern, by in cleaning.ARTICLE:
        x = f"regexp_replace({x}, {quoted('(?ims)' + pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    x = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    for sign, by in cleaning.QUOTES:
        x = f"replace({x}, {quoted(sign)}, {quoted(by)})"
    return x


@query(rf"""
WITH c AS (SELECT doc_id, {clean_sql(f"coalesce(text, '') || {quoted(NORMAL_MARKUP)}")} AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 10 OR regexp_matches(x, '^\d+\.?\s*$') OR regexp_matches(x, '^[^\p{{L}}\p{{N}}_]*$') THEN '' ELSE x END AS cleaned FROM c""")
def article_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with markup behind them, cleaned as articles; the SQL starts from the normal form of the markup."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(MARKUP))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_article(text).alias("cleaned"))


LINE = "coalesce(regexp_extract(text, '^(?:[^\\n]*\\n){{{n}}}([^\\n]*)', 1), '')"
PARTS_SQL = "p AS (SELECT doc_id, source, lang, " + ", ".join(f"{LINE.format(n=n)} AS l{n}" for n in range(4)) + " FROM documents)"
TITLE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Port of ' || source WHEN 1 THEN source || ' Tanker' ELSE source END"


def escaped(line: Column) -> Column:
    x = F.replace(line, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of an encyclopaedia: lines are paragraphs, among tables, notes, boxes and sections that are no text."""
    line = lambda n: escaped(F.coalesce(F.regexp_extract("text", rf"^(?:[^\n]*\n){{{n}}}([^\n]*)", 1), F.lit("")))
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    html = put(
        '<html><body><h1 id="firstHeading"> ', F.expr(TITLE_SQL), ' </h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output">',
        "<table><tr><td><p>cell</p><table><tr><td>inner</table></table><p>", line(0), '<sup class="reference">[1]</sup></p>',
        '<div class="navbox"><p>box</p><div><p>deeper</p></div></div><p>', line(1), "<style>p{margin:0}</style></p>",
        '<h2>History<span class="mw-editsection">[edit]</span></h2><p>', line(2), "</p><h3>References</h3><p>", line(3), "</p></div></div></div>",
        '<div id="mw-normal-catlinks"><ul><li><a href="/c">', F.expr("CASE WHEN doc_id % 5 = 0 THEN 'Ships of ' || lang WHEN doc_id % 7 = 0 THEN 'Diseases of ships' ELSE 'Things' END"),
        "</a></li></ul></div></body></html>",
    )
    return table(spark, sf_dir, "documents").select("doc_id", html.alias("html"), F.concat(F.lit("/wiki/"), F.col("doc_id").cast("string")).alias("url"))


DOMAIN = encyclopaedia.Terms(PRIMARY, ENTITY, SECONDARY, VETO)
NN = "chr(10) || chr(10)"
SCORE = f"least(1.0, (3 * {terms_sql(PRIMARY)} + 2 * {terms_sql(ENTITY)} + {terms_sql(SECONDARY)}) / (len({WORDS}) + 100) * 20)"
VETOED = "(" + " + ".join(f"contains(lower(text), '{v}')::INT" for v in VETO) + " >= 2)"
#: Score and number of primary terms of a column text; a vetoed text has none.
FACTS = f"CASE WHEN {VETOED} THEN 0.01 ELSE {SCORE} END AS score, CASE WHEN {VETOED} THEN 0 ELSE {terms_sql(PRIMARY)} END AS primaries"
ARTICLES_SQL = f"""
WITH {PARTS_SQL}, a AS (
  SELECT doc_id, {TITLE_SQL} AS title, CASE WHEN doc_id % 5 = 0 THEN 'Ships of ' || lang WHEN doc_id % 7 = 0 THEN 'Diseases of ships' ELSE 'Things' END AS category,
    l0 || '[1]' || {NN} || l1 || {NN} || l2 || {NN} AS lead, l0 || '[1]' || {NN} || l1 || {NN} || l2 || {NN} || l3 || {NN} AS whole,
    l0 || {NN} || l1 || {NN} || l2 || {NN} || l3 || {NN} || {NN} || 'History' || {NN} || l2 || {NN} AS content FROM p),
f AS (SELECT doc_id, {FACTS} FROM (SELECT doc_id, lead AS text FROM a)), g AS (SELECT doc_id, {FACTS} FROM (SELECT doc_id, whole AS text FROM a)), h AS (SELECT doc_id, {FACTS} FROM (SELECT doc_id, content AS text FROM a)),
r AS (SELECT a.doc_id, title, content, CASE WHEN doc_id % 4 = 0 THEN greatest(0.8, h.score) WHEN doc_id % 4 = 1 THEN greatest(0.7, h.score) WHEN contains(lower(category), 'ship') THEN greatest(0.5, h.score) ELSE h.score END AS relevance
  FROM a JOIN f USING (doc_id) JOIN g USING (doc_id) JOIN h USING (doc_id)
  WHERE NOT contains(lower(category), 'diseases') AND (doc_id % 4 < 2 OR contains(lower(category), 'ship') OR (f.score >= 0.035 AND f.primaries >= 1) OR (g.score >= 0.015 AND g.primaries >= 1)))"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encyclopaedia.articles(wiki_pages(spark, sf_dir), "html", "url", ("doc_id",), DOMAIN, ("Category:Diseases",))


@query(ARTICLES_SQL + " SELECT doc_id, title, content, round(relevance, 6) AS relevance FROM r")
def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed as trees, judged by title, category and lead; the SQL puts the article together from the parts of the page."""
    return wiki(spark, sf_dir).select("doc_id", "title", "content", F.round("relevance", 6).alias("relevance"))


@query(ARTICLES_SQL + " SELECT content AS text, title, '/wiki/' || doc_id AS url, round(relevance, 6) AS relevance FROM r WHERE relevance >= 0.3")
def corpus_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training corpus: articles of enough relevance, the most relevant first."""
    return encyclopaedia.corpus(wiki(spark, sf_dir), 0.3).withColumn("relevance", F.round("relevance", 6))


@query(f"WITH f AS (SELECT doc_id, {FACTS} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT doc_id, score >= 0.5 AND primaries >= 3 AS related FROM f")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", encyclopaedia.related(F.col("text"), DOMAIN, 0.5, 3).alias("related"))


OBJECT_SQL = """'{"name": "' || p_name || ' {x} \\" }", "size": {"n": ' || p_size || ', "of": "}{"}}'"""


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN {OBJECT_SQL} END AS object FROM part")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six kinds around an object made from a part: bare, quoted, fenced, after a thought, before another object, and one that is never closed."""
    body = F.concat(F.lit('{"name": "'), "p_name", F.lit(' {x} \\" }", "size": {"n": '), F.col("p_size").cast("string"), F.lit(', "of": "}{"}}'))
    around = {0: ("", ""), 1: ("'\" ", " \"'"), 2: ("Sure:\n```json\n", "\n```"), 3: ("<think>{ perhaps }</think>", " }"), 4: ("", ' and {"second": 1}')}
    said = F.concat(F.lit("{ not closed: "), "p_name")
    for kind, (before, after) in around.items():
        said = F.when(F.col("p_partkey") % 6 == kind, F.concat(F.lit(before), body, F.lit(after))).otherwise(said)
    return table(spark, sf_dir, "part").select("p_partkey", json_text.answer_object(said).alias("object"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range((len(t) + 511) // 512)) AS chunk FROM t)
SELECT doc_id, chunk, len(t[chunk * 512 + 1:chunk * 512 + 512]) AS n_tokens, array_to_string(t[chunk * 512 + 1:chunk * 512 + 512], ' ') AS content FROM c""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in consecutive chunks of 512 tokens; the last one is shorter."""
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.chunks(fx.words("text"), 512)).alias("chunk", "c"))
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n_tokens"), F.array_join("c", " ").alias("content"))


#: Phrases of the domain, and signs of good and bad text, which the given texts don't hold.
PHRASES = (
    " The bulk carrier of 75,000 DWT sailed from Port Said through the Suez Canal at 14.5 knots.", " Under the charterparty terms, freight of US$25 million per voyage is due.",
    " Click here to read more. All rights reserved.", " VLCC rates rose, according to the contract.", "",
)


def with_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), phrase).alias("text"))


@query()
def maritime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, quality and the first rule failed, by the full catalogues."""
    made = maritime.scored(with_phrases(spark, sf_dir), "text")
    return made.select("doc_id", F.round("relevance", 6).alias("relevance"), F.round("quality", 6).alias("quality"), "sentences", "rejection")


NAMED = "'/wiki/' || CASE doc_id % 4 WHEN 0 THEN 'Star_(' || {ending} || ')' WHEN 1 THEN 'Category:' || {category} WHEN 2 THEN 'Harbour_of_' || source ELSE 'category:sea_' || {ending} END"


def pick_sql(names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN floor(doc_id / 4) % {len(names) + 3} = {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'ships' END"


ADDRESS = NAMED.format(ending=pick_sql(maritime.BLOCKED_ENDINGS), category=pick_sql(tuple(c.partition(":")[2] for c in maritime.BLOCKED_CATEGORIES)))


@query(
    f"WITH a AS (SELECT doc_id, {ADDRESS} AS url FROM documents) SELECT doc_id, url FROM a WHERE NOT (" + " OR ".join(f"contains(replace(lower(url), '_', ' '), '{c.lower().replace('_', ' ')}')" for c in maritime.BLOCKED_CATEGORIES)
    + " OR " + " OR ".join(f"contains(lower(url), '_({e.lower()})')" for e in maritime.BLOCKED_ENDINGS) + ")"
)
def unblocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from documents that neither name a blocked category nor end in a blocked name."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(ADDRESS).alias("url"))
    return rows.where(~labels.blocked(F.col("url"), maritime.BLOCKED_CATEGORIES, maritime.BLOCKED_PATTERNS))


@query("""SELECT p_partkey, p_name || p_brand AS headline, CASE WHEN p_partkey % 2 = 1 THEN '2024-05-06' ELSE '2024-01-02' END AS published, CASE WHEN p_partkey % 3 = 0 THEN 'Desk & Co' ELSE 'By ' || p_type END AS author,
 'First ' || p_name || '. Size ' || p_size || ' ofit.' AS content FROM part""")
def news_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of a news site, among menus, cards, tags and related articles that are no text."""
    put = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    c, odd = F.col, F.col("p_partkey") % 2 == 1
    html = put(
        '<html><head><meta property="article:published_time" content="2024-01-02">', F.when(c("p_partkey") % 3 == 0, '<meta name="author" content="Desk &amp; Co">').otherwise(""),
        '</head><body><h1 class="site">Menu</h1><h1 class="big entry-title"> ', c("p_name"), "  <b>", c("p_brand"), "</b></h1>", F.when(odd, '<time datetime="2024-05-06">in May</time>').otherwise(""),
        '<span class="post-author-name"> By ', c("p_type"), ' </span><div class="article"><p>not this one</p></div><div class="td-post-content wide"><p>First ', c("p_name"),
        '.</p><div class="related-articles-box"><p>gone</p></div><ul class="x tags-list"><li><p>gone</p></li></ul><p>Size ', c("p_size").cast("string"), "  of <i>it</i>.<span class=card>gone</span></p></div></body></html>",
    )
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return elements.news_articles(parts.select("p_partkey", html.alias("html")), "html", ("p_partkey",), elements.SITES["daily"])
