"""Queries on tokens, diversity, cleaning and sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import cleaning, text as fx
from textmill.operators import diversity
from textmill.plans.registry import query
from textmill.sources.tables import table

TOKENS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+'), lambda x: lower(x)), lambda x: NOT regexp_matches(x, '^[!-/:-@\[-`{-~]$'))"
WORDS = r"regexp_extract_all(coalesce(text, ''), '\S+')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]+)\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


def grams(group: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {group} AS g, {TOKENS} AS t FROM documents),
e AS (SELECT g, doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM d),
l AS (SELECT g, tok, lead(tok, 1) OVER w AS t2, lead(tok, 2) OVER w AS t3 FROM e WINDOW w AS (PARTITION BY g ORDER BY doc_id, pos)),
r AS (SELECT g, count(*) AS tokens, count(DISTINCT tok) / count(*) AS d1, count(DISTINCT CASE WHEN t2 IS NOT NULL THEN tok || ' ' || t2 END) / count(t2) AS d2, count(DISTINCT CASE WHEN t3 IS NOT NULL THEN tok || ' ' || t2 || ' ' || t3 END) / count(t3) AS d3 FROM l GROUP BY g)
SELECT g AS {group}, tokens, round(d1, 6) AS distinct_1, round(d2, 6) AS distinct_2, round(d3, 6) AS distinct_3"""


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_types FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fx.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query(grams("source") + ", round((d1 + d2 + d3) / 3, 6) AS mean_ttr FROM r")
def ttr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diversity.distinct_ratios(table(spark, sf_dir, "documents"), "source")
    return made.select("source", "tokens", *[F.round(f"distinct_{n}", 6).alias(f"distinct_{n}") for n in (1, 2, 3)], F.round("mean_ratio", 6).alias("mean_ttr"))


@query(grams("lang") + " FROM r")
def distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diversity.distinct_ratios(table(spark, sf_dir, "documents"), "lang")
    return made.select("lang", "tokens", *[F.round(f"distinct_{n}", 6).alias(f"distinct_{n}") for n in (1, 2, 3)])


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos, len(t) AS n FROM d),
w AS (SELECT doc_id, n, tok, unnest(range(greatest(0, (pos - 25 + 9) // 10), (pos - 1) // 10 + 1)) AS j FROM e WHERE n >= 25),
r AS (SELECT doc_id, j, count(DISTINCT tok) / 25 AS share FROM w WHERE j * 10 + 25 <= n GROUP BY doc_id, j), a AS (SELECT doc_id, avg(share) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN len(t) >= 25 THEN m WHEN len(t) = 0 THEN 0 ELSE len(list_distinct(t)) / len(t) END, 6) AS normalized_ttr FROM d LEFT JOIN a ON a.doc_id = d.doc_id""")
def windowed_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fx.windowed_ttr(fx.tokens("text")), 6).alias("normalized_ttr"))


def verbosity_sql(group: str) -> str:
    return f"""
WITH c AS (SELECT {group} AS g, len({WORDS}) AS w, len({SENTENCES}) AS s FROM documents)
SELECT g AS {group if group != "'all'" else 'scope'}, count(*) AS docs, round(sum(w) / count(*), 6) AS words_per_doc, round(sum(s) / count(*), 6) AS sentences_per_doc, round(sum(w) / sum(s), 6) AS words_per_sentence FROM c GROUP BY g"""


def _verbosity(df: DataFrame, by: str) -> DataFrame:
    return diversity.verbosity(df, [by]).select(by, "docs", *[F.round(c, 6).alias(c) for c in ("words_per_doc", "sentences_per_doc", "words_per_sentence")])


@query(verbosity_sql("'all'"))
def verbosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verbosity(table(spark, sf_dir, "documents").withColumn("scope", F.lit("all")), "scope")


@query(verbosity_sql("source"))
def verbosity_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verbosity(table(spark, sf_dir, "documents"), "source")


@query(f"""
WITH c AS (SELECT lang, len({WORDS}) AS w, len({SENTENCES}) AS s, len(regexp_extract_all(lower(text), '[aeiouyäöüàâéèêëîïôûùóíúá]+')) AS y FROM documents)
SELECT lang, round(206.835 - 1.015 * (sum(w) / sum(s)) - 84.6 * (sum(y) / sum(w)), 4) AS flesch FROM c GROUP BY lang""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("lang", F.size(fx.words("text")).alias("w"), F.size(fx.sentences("text")).alias("s"), fx.syllables("text").alias("y"))
    return parts.groupBy("lang").agg(F.round(diversity.reading_ease(F.sum("w"), F.sum("s"), F.sum("y")), 4).alias("flesch"))


@query("""
SELECT lang, count(*) AS docs, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share, min(n_chars) AS least, round(avg(n_chars), 4) AS mean, max(n_chars) AS most,
 count(*) FILTER (WHERE n_chars > 500) AS over_500, count(*) FILTER (WHERE n_chars > 1000) AS over_1000, count(*) FILTER (WHERE contains(text, '@')) AS with_at FROM documents GROUP BY lang""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("docs"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("most"),
        F.count_if(F.col("n_chars") > 500).alias("over_500"), F.count_if(F.col("n_chars") > 1000).alias("over_1000"), F.count_if(F.col("text").contains("@")).alias("with_at"),
    )
    total = made.agg(F.sum("docs").alias("all_docs"))
    return made.join(F.broadcast(total)).withColumn("share", F.round(F.col("docs") * 100.0 / F.col("all_docs"), 4)).drop("all_docs")


@query(f"""
WITH c AS (SELECT source, len({TOKENS}) AS n FROM documents), r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) AS i, count(*) OVER (PARTITION BY source) AS m FROM c)
SELECT source, max(m) AS n, round(CASE WHEN max(m) < 2 THEN 0 ELSE sum((2 * i - m - 1) * n) / (max(m) * (max(m) - 1) / 2) END, 6) AS distance FROM r GROUP BY source""")
def syntactic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("source", F.size(fx.tokens("text")).cast("long").alias("size"))
    return diversity.mean_pairwise_difference(sizes, "size", ["source"]).select("source", "n", F.round("distance", 6).alias("distance"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '(\d+) ?\. ?(\d+)', '\1.\2', 'g')) AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.normalize_text("text").alias("normal"))


@query(r"SELECT doc_id, CASE WHEN text = 'None' THEN '' ELSE trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) END AS form FROM documents")
def compare_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.compare_form("text").alias("form"))


def sql_literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"SELECT page_id, regexp_replace(html, {sql_literal(cleaning.URL)}, '[URL]', 'g') AS scrubbed FROM pages")
def url_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cleaning.scrub_urls("html").alias("scrubbed"))


def pii_sql() -> str:
    x = "text"
    for kind, pattern in cleaning.PII.items():
        x = f"regexp_replace({x}, {sql_literal(pattern)}, '[{kind.upper()}]', 'g')"
    return x


@query(f"SELECT doc_id, {pii_sql()} AS scrubbed FROM documents")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.scrub_pii("text").alias("scrubbed"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {sql_literal(p)})) AS n_{k}" for k, p in cleaning.PII.items()) + " FROM documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(f"n_{k}") for k, p in cleaning.PII.items()])


@query("SELECT p_partkey, regexp_replace(p_size || ' kg ' || p_name || ' ' || p_partkey || '  km', '(\\d) +(" + "|".join(sorted(fx.UNITS, key=lambda u: (-len(u), u))) + ")\\b', '\\1\\2', 'g') AS joined FROM part")
def unit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat_ws("", "p_size", F.lit(" kg "), "p_name", F.lit(" "), "p_partkey", F.lit("  km"))
    return table(spark, sf_dir, "part").select("p_partkey", fx.join_units(made).alias("joined"))


def wiki_sql() -> str:
    x = "text || ' [12] (ref ) see /x/ here ,ok'"
    for pattern, by in cleaning.WIKI:
        x = f"regexp_replace({x}, {sql_literal(pattern)}, '{by.replace('$', chr(92))}', 'g')"
    return f"trim({x})"


@query(f"SELECT doc_id, {wiki_sql()} AS cleaned FROM documents")
def wiki_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_wiki(F.concat("text", F.lit(" [12] (ref ) see /x/ here ,ok"))).alias("cleaned"))


@query()
def email_clean_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_mail_light("text").alias("cleaned"))


@query()
def email_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_mail_full("text").alias("cleaned"))


@query(f"""
WITH h AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({"|".join(fx.ABBREVIATIONS)})\\.', '\\1\\2' || chr(2), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '[.!?]+(\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: length(x) >= 15) AS s FROM h)
SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.protected_sentences("text")).alias("pos", "sentence"))
    return made.withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, array_to_string(({WORDS})[1:150], ' ') AS head FROM documents")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.truncate_words("text").alias("head"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.preview("text").alias("preview"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S')) AS n FROM documents")
def ner_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fx.ner_tokens("text")).cast("long").alias("n"))
