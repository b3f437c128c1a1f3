"""Queries on TF-IDF, rules, spans, labels and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators import evaluate, extract, terms
from textmill.operators.lineage import cut
from textmill.plans.registry import query
from textmill.sources.tables import table

TFIDF = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9/-]*') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS pos FROM w),
l AS (SELECT doc_id, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, a AS term FROM l UNION ALL SELECT doc_id, a || ' ' || b FROM l WHERE b IS NOT NULL UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM l WHERE c IS NOT NULL),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS docs FROM documents),
s AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term), k AS (SELECT term, ln((1 + docs) / (1 + df)) + 1 AS idf FROM s, n WHERE df >= 2 AND df <= 0.8 * docs ORDER BY cf DESC, term LIMIT 5000),
r AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN k USING (term)), q AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1),
t AS (SELECT doc_id, term, w / norm AS weight FROM r JOIN q USING (doc_id))"""


@query(TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight FROM t")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


@query(TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM t) WHERE rank <= 100 AND weight > 0.1")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract.top_terms(extract.tfidf(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


STOPS = ("the", "and", "of", "der", "die", "und", "la", "le", "de", "que", "el", "en", "in", "to", "is")


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN (" + ", ".join(f"'{s}'" for s in STOPS) + ") GROUP BY word ORDER BY n DESC, word LIMIT 200")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent keywords (a top-k report)."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where((F.length("word") > 2) & ~F.col("word").isin(*STOPS)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200)


DICTIONARY = ("tion", "pathetic", "clown", "keit", "mente", "eau")


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in DICTIONARY) + "], lambda t: contains(lower(text), t)), ',') AS terms FROM documents")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.dictionary_hits(F.col("text"), DICTIONARY), ",").alias("terms"))


@query("""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark),
h AS (SELECT doc_id, term FROM documents JOIN t ON contains(lower(coalesce(text, '')), term))
SELECT doc_id, count(*) AS n_terms, md5(string_agg(term, ',' ORDER BY term)) AS terms_md5 FROM h GROUP BY doc_id""")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark that occur in each document, anywhere in its text; documents without one have no row."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")
    dictionary = [r.term for r in table(spark, sf_dir, "benchmark").select(words).distinct().collect()]
    hits = terms.listed(table(spark, sf_dir, "documents"), dictionary, "text", "doc_id")
    found = hits.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"))
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", ",").cast("binary")).alias("terms_md5"))


def rule_sql(base: str, key: str, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT {key}, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(m, '{p}', {group}), lambda x: lower(trim(x))))), ',') AS found FROM ({base})"


MAILS_SQL = "SELECT p_partkey, 'Fixed MV ' || replace(p_name, '_', ' ') || ' and M/V Ocean Star from ' || lower(split_part(p_type, ' ', 1)) || ' to rotterdam, ' || p_size || ',000 mt of ' || 'grain CIF basis, CFR no' AS m FROM part"


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade phrases made from the parts."""
    m = F.concat(F.lit("Fixed MV "), F.replace("p_name", F.lit("_"), F.lit(" ")), F.lit(" and M/V Ocean Star from "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(" to rotterdam, "), "p_size", F.lit(",000 mt of grain CIF basis, CFR no"))
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))


def _rule(spark: SparkSession, sf_dir: str, pattern: str, group: int) -> DataFrame:
    return mails(spark, sf_dir).select("p_partkey", F.array_join(extract.extract_distinct(F.col("m"), pattern, group), ",").alias("found"))


@query(rule_sql(MAILS_SQL, "p_partkey", extract.PREFIXED, 1))
def rule_extract_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, extract.PREFIXED, 1)


@query(rule_sql(MAILS_SQL, "p_partkey", extract.FROM_TO, 2))
def rule_extract_fromto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, extract.FROM_TO, 2)


@query(rule_sql(MAILS_SQL, "p_partkey", extract.QUANTITY, 2))
def rule_extract_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, extract.QUANTITY, 2)


@query(rule_sql(MAILS_SQL, "p_partkey", rf"(?:^|[^A-Za-z])({'|'.join(extract.CODES)})(?:$|[^A-Za-z])", 1))
def rule_extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select("p_partkey", F.array_join(extract.code_matches(F.col("m")), ",").alias("found"))


NER = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S')"
SPANS_SQL = f"""
WITH t AS (SELECT doc_id, unnest(list_transform({NER}, lambda x: lower(x))) AS tok, unnest(range(0, len({NER}))) AS pos FROM documents),
l AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM t),
e AS (SELECT *, len(string_split(entity, ' ')) AS k FROM (VALUES ('of the', 'pair'), ('that', 'word'), ('der', 'word'), ('la', 'word'), ('in the', 'pair')) v(entity, type)),
s AS (SELECT doc_id, entity, type, k, pos AS start FROM l JOIN e ON tok = split_part(entity, ' ', 1) AND (k = 1 OR nxt = split_part(entity, ' ', 2)))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = [("of the", "pair"), ("that", "word"), ("der", "word"), ("la", "word"), ("in the", "pair")]
    return extract.aligned(table(spark, sf_dir, "documents"), entities)


@query(SPANS_SQL + ' SELECT doc_id, entity, type, start, start + k - 1 AS "end" FROM s')
def span_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@query(SPANS_SQL + """, g AS (SELECT doc_id, lead(start) OVER (PARTITION BY doc_id ORDER BY start, start + k - 1) - (start + k - 1) - 1 AS gap FROM s)
SELECT doc_id, count(*) AS gaps, round(avg(CASE WHEN gap <= 0 THEN 1.0 WHEN gap <= 2 THEN 0.7 WHEN gap <= 5 THEN 0.4 ELSE 0.0 END), 6) AS overlap_score FROM g WHERE gap IS NOT NULL GROUP BY doc_id""")
def span_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.gap_classes(spans(spark, sf_dir)).withColumn("overlap_score", F.round("overlap_score", 6))


@query(SPANS_SQL + " SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s GROUP BY entity")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("WITH c AS (SELECT event_type || '-' || user_id AS label, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS labels, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n <= 5) AS rare, round(avg(n), 4) AS mean, median(n)::DOUBLE AS middle FROM c")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.concat_ws("-", "event_type", "user_id").alias("label")).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("labels"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") <= 5).alias("rare"), F.round(F.avg("n"), 4).alias("mean"), F.median("n").alias("middle"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60)")
def common_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.common_labels(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 60)


@query("SELECT source, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY source HAVING count(*) >= 5")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_list("doc_id").alias("ids")).where(F.size("ids") >= 5)
    return made.select("source", F.array_join(F.sort_array("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT source, doc_id // 1000 AS block, array_to_string(list_sort(list(doc_id)), ',') AS ids, count(*) AS n FROM documents GROUP BY 1, 2")
def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index in blocks of a thousand keys, so no row grows with the table."""
    block = F.floor(F.col("doc_id") / 1000).alias("block")
    made = table(spark, sf_dir, "documents").groupBy("source", block).agg(F.collect_list("doc_id").alias("ids"))
    return made.select("source", "block", F.array_join(F.sort_array("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(SPANS_SQL + ", f AS (SELECT entity, type, min(doc_id * 1000000 + start) AS first FROM s GROUP BY 1, 2) SELECT type, entity, row_number() OVER (PARTITION BY type ORDER BY first) - 1 AS id FROM f")
def entity_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    first = spans(spark, sf_dir).groupBy("entity", "type").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return first.select("type", "entity", (F.row_number().over(W.partitionBy("type").orderBy("first")) - 1).cast("long").alias("id"))


PREDICTIONS = """
WITH p AS (SELECT d.doc_id, d.lang, (CASE WHEN len(regexp_extract_all(text, '[#$%&*]{2,}')) = 0 THEN 'good' ELSE 'bad' END) AS found, (CASE WHEN l.quality = 1 THEN 'good text' ELSE 'bad text' END) AS label, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = F.when(F.regexp_count("text", F.lit("[#$%&*]{2,}")) == 0, "good").otherwise("bad")
    return docs.select("doc_id", "lang", found.alias("found"), F.when(F.col("quality") == 1, "good text").otherwise("bad text").alias("label"), "quality", "toxic")


@query(PREDICTIONS + ", m AS (SELECT doc_id, contains(label, found)::BIGINT AS hit FROM p) SELECT doc_id, hit AS tp, 1 - hit AS fp, 1 - hit AS fn FROM m")
def scalar_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("doc_id", evaluate.scalar_match(F.col("found"), F.col("label")).alias("m")).select("doc_id", "m.tp", "m.fp", "m.fn")


@query(PREDICTIONS + """, m AS (SELECT lang, contains(label, found)::BIGINT AS hit FROM p), s AS (SELECT lang, hit AS tp, 1 - hit AS fp, 1 - hit AS fn FROM m),
r AS (SELECT lang, round(avg(tp), 4) AS macro_precision, round(avg(tp), 4) AS macro_recall, round(avg(tp), 4) AS macro_f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY lang),
q AS (SELECT *, round(tp / (tp + fp), 4) AS micro_precision, round(tp / (tp + fn), 4) AS micro_recall FROM r) SELECT *, round(2 * micro_precision * micro_recall / (micro_precision + micro_recall), 4) AS micro_f1 FROM q""")
def prf_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("lang", evaluate.scalar_match(F.col("found"), F.col("label")).alias("m")).select("lang", "m.*")
    rows = rows.select("lang", "tp", "fp", "fn", *evaluate.scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return evaluate.roll_up(rows, ["lang"])


@query()
def greedy_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of neighbouring lines against those of the whole text: greedy one-to-one matching."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.slice(fx.tokens("text"), 1, 6)).alias("found"), F.array_sort(F.slice(fx.tokens("text"), 4, 6)).alias("labels"))
    return docs.select("doc_id", evaluate.greedy_match(F.col("found"), F.col("labels")).alias("m")).select("doc_id", "m.*")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, w[1:4] AS f, w[3:5] AS l FROM t)
SELECT doc_id, len(list_filter(l, lambda x: len(list_filter(f, lambda y: contains(y, x))) = 0)) AS missing, len(list_filter(f, lambda y: len(list_filter(l, lambda x: contains(y, x))) = 0)) AS extra,
 len(list_filter(l, lambda x: len(list_filter(f, lambda y: contains(y, x))) = 0)) = 0 AS all_found FROM p""")
def accuracy_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    made = w.select("doc_id", evaluate.list_accuracy(F.slice("w", 1, 4), F.slice("w", 3, 3)).alias("m"))
    return made.select("doc_id", F.size("m.missing").cast("long").alias("missing"), F.size("m.extra").cast("long").alias("extra"), "m.all_found")


@query(SPANS_SQL + """, f AS (SELECT DISTINCT doc_id, start, type FROM s WHERE start % 3 <> 0), g AS (SELECT DISTINCT doc_id, start, type FROM s WHERE start % 5 <> 0),
c AS (SELECT coalesce(f.type, g.type) AS type, count(*) FILTER (WHERE f.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE f.doc_id IS NULL) AS fn FROM f FULL JOIN g ON f.doc_id = g.doc_id AND f.start = g.start AND f.type = g.type GROUP BY 1)
SELECT type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def span_exact_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that two imaginary annotators kept, by type."""
    all_spans = cut(spans(spark, sf_dir).select("doc_id", "start", "type"))
    made = evaluate.exact_spans(all_spans.where("start % 3 <> 0"), all_spans.where("start % 5 <> 0"), ["doc_id", "start", "type"], ["type"])
    return made.select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
WITH s AS (SELECT round(d.n_chars / 1000.0, 3) AS score, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT DISTINCT score AS t FROM s),
a AS (SELECT t, sum((score >= t)::INT * y) AS tp, sum((score < t)::INT * (1 - y)) AS tn, sum(y) AS p, count(*) AS n FROM t, s GROUP BY t)
SELECT t AS threshold, round((tp + tn) / n, 6) AS accuracy, round(tp / p, 6) AS tpr, round(tn / (n - p), 6) AS tnr FROM a ORDER BY tp + tn DESC, t LIMIT 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.round(F.col("n_chars") / 1000.0, 3).cast("double").alias("score"), "quality")
    made = evaluate.threshold_sweep(rows, "score", "quality")
    return made.select("threshold", *[F.round(c, 6).alias(c) for c in ("accuracy", "tpr", "tnr")])
