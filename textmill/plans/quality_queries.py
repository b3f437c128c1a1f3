"""Queries on scores, filters, segments and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators import dedup, quality
from textmill.plans.registry import query
from textmill.plans.text_queries import SENTENCES, WORDS
from textmill.sources.tables import table


def count_sql(pattern: str) -> str:
    return "len(regexp_extract_all(text, '" + pattern.replace("'", "''") + "'))"


RELEVANCE = "((" + " + ".join(f"{w} * {count_sql(p)}" for _, w, p in quality.DOMAIN) + f") / nullif(len({WORDS}), 0))"
QUALITY = "CASE WHEN len(" + WORDS + ") = 0 THEN -1 ELSE (" + " + ".join(map(count_sql, quality.GOOD)) + " - " + " - ".join(map(count_sql, quality.BAD)) + f") / len({WORDS}) END"
REASON = f"""CASE WHEN length(text) < 50 THEN 'too_short' WHEN length(text) > 8192 THEN 'too_long' WHEN len({WORDS}) < 10 THEN 'too_few_words' WHEN len({WORDS}) > 1200 THEN 'too_many_words'
 WHEN len({SENTENCES}) < 2 THEN 'too_few_sentences' WHEN coalesce({RELEVANCE}, 0) < 0.005 THEN 'not_relevant' WHEN {QUALITY} < -0.02 THEN 'low_quality' END"""
PRIMARY, ENTITY, SECONDARY, VETO = ("the", "der "), ("tion", "heit"), ("and", "und", "que"), ("clown", "pathetic")


def terms_sql(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}" for t in terms) + ")"


@query(f"SELECT doc_id, round(coalesce({RELEVANCE}, 0), 6) AS relevance FROM documents")
def domain_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.domain_relevance(F.col("text")), 6).alias("relevance"))


@query(f"SELECT doc_id, round({QUALITY}, 6) AS quality FROM documents")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.quality_score(F.col("text")), 6).alias("quality"))


@query(f"""SELECT doc_id, round(CASE WHEN contains(lower(text), 'clown')::INT + contains(lower(text), 'pathetic')::INT >= 2 THEN 0.01
 ELSE least(1.0, (3 * {terms_sql(PRIMARY)} + 2 * {terms_sql(ENTITY)} + {terms_sql(SECONDARY)}) / (len({WORDS}) + 100) * 20) END, 6) AS score FROM documents""")
def weighted_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.weighted_term_score(F.col("text"), PRIMARY, ENTITY, SECONDARY, VETO), 6).alias("score"))


@query(f"SELECT doc_id, {REASON} AS rejection_reason FROM documents")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality.rejection_reason(F.col("text")).alias("rejection_reason"))


@query(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS docs, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY 1")
def rejection_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rejections(table(spark, sf_dir, "documents")).withColumn("percent", F.round("percent", 4))


@query()
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(quality.segments(fx.protected_sentences("text"), 200)).alias("segment_index", "content"))
    return made.withColumn("word_count", F.size(fx.words("content")))


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(quality.overlapping_chunks(fx.protected_sentences("text"))).alias("chunk_id", "c"))
    return made.select("doc_id", "chunk_id", F.col("c.start").alias("start_sentence"), F.col("c.end").alias("end_sentence"), F.col("c.text").alias("text"), F.length("c.text").alias("size"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "first_id", "copies")


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (-F.col("n_chars")).alias("less"))
    return dedup.keep_first(docs, ["source", "lang"], ["less", "doc_id"]).drop("less")


SHINGLES = rf"""
WITH w AS (SELECT doc_id, unnest(list_transform({WORDS}, lambda x: lower(x))) AS w, unnest(range(len({WORDS}))) AS pos FROM documents),
l AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x AS g FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT DISTINCT doc_id, g FROM l WHERE g IS NOT NULL), e AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM d),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2, 3, 4),
p AS (SELECT a, b, shared / (na + nb - shared) AS similarity FROM c WHERE shared / (na + nb - shared) >= 0.85)"""


@query(SHINGLES + """, k AS (SELECT doc_id, list_sort(list(g)) AS s FROM e GROUP BY 1), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class FROM k)
SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE a IN (SELECT class FROM r) AND b IN (SELECT class FROM r) UNION ALL SELECT class, doc_id, 1.0 FROM r WHERE class <> doc_id""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives and, for copies, of the representative and the copy."""
    return dedup.near_pairs(table(spark, sf_dir, "documents")).withColumn("similarity", F.round("similarity", 6))


@query(SHINGLES + " SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT b FROM p)")
def near_dup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_near(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


EIGHT = "w || ' ' || " + " || ' ' || ".join(f"lead(w, {i}) OVER x" for i in range(1, 8))


@query(rf"""
WITH m AS (SELECT doc_id, unnest(list_transform({WORDS}, lambda x: lower(x))) AS w, unnest(range(len({WORDS}))) AS pos FROM documents), i AS (SELECT item_id, unnest(list_transform({WORDS}, lambda x: lower(x))) AS w, unnest(range(len({WORDS}))) AS pos FROM benchmark),
mg AS (SELECT doc_id, {EIGHT} AS g FROM m WINDOW x AS (PARTITION BY doc_id ORDER BY pos)), ig AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, {EIGHT} AS g FROM i WINDOW x AS (PARTITION BY item_id ORDER BY pos)))
SELECT doc_id, count(DISTINCT item_id) AS items, count(DISTINCT mg.g) AS shared FROM mg JOIN ig ON mg.g = ig.g GROUP BY doc_id""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
SELECT DISTINCT lower(trim(c_mktsegment)) AS c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) <> '' AND lower(trim(c_mktsegment)) NOT IN (SELECT lower(trim(c_mktsegment)) FROM customer WHERE c_custkey <= 2)""")
def blacklist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return dedup.without_listed(customers, "c_mktsegment", customers.where("c_custkey <= 2"), "c_mktsegment")


@query("SELECT url, page_id FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, page_id FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def incremental_url_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of the pages: the later one adds the addresses that the first lacks."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    return dedup.merge_new(pages.where("page_id % 2 = 1"), pages.where("page_id % 3 = 0"), "url")
