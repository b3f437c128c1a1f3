"""Queries on conversations, pages, JSON answers and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators import chains, pages
from textmill.plans.registry import query
from textmill.sources.tables import table


@query("SELECT conv_id, count(*) AS n, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def chain_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.concat_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, text AS body FROM conversations WHERE trim(text) <> ''")
def chain_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested chains, and flat again."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("body"))))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("email_chain"))
    return chains.flatten_chain(nested, "email_chain", "body").withColumn("position", F.col("position").cast("long"))


@query("SELECT conv_id, turn, text AS body FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id) AND trim(text) <> ''")
def chain_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("body"))
    return first.where(F.trim("body") != "")


@query(r"""
WITH c AS (SELECT conv_id, string_agg('Email ' || (turn + 1) || ': ' || text, chr(10) ORDER BY turn) AS chain FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(range(0, len(p))) AS position, unnest(p) AS mail FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(chain, '(?:<)?Email\s*\d+(?:>)?:\s*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM c)""")
def chain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("Email "), F.col("turn") + 1, F.lit(": "), "text"))
    joined = chains.concat_turns(rows, "conv_id", "turn", "t", "\n")
    return joined.select("conv_id", F.posexplode(chains.split_chain(F.col("text"))).alias("position", "mail")).withColumn("position", F.col("position").cast("long"))


@query("""
WITH u AS (SELECT conv_id, text AS ask, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
SELECT conv_id, place, ask, answer FROM u JOIN a USING (conv_id, place)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = chains.positional(turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ask")), turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("answer")), ["conv_id"], "turn", "at")
    return made.select("conv_id", F.col("place").cast("long").alias("place"), "ask", "answer")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made from events: fenced, thoughtful, bare and broken ones."""
    x = F.concat(F.lit('{"vessel": "'), "event_type", F.lit('", "commodity": "'), F.col("user_id").cast("string"), F.lit('"}'))
    kind = F.pmod("event_id", F.lit(4))
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), x, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("<think>\nhm {</think>\nSure: "), x, F.lit(" done"))).when(kind == 2, F.concat(F.lit("vessel: "), "event_type", F.lit("\ncommodity: "), F.col("user_id").cast("string"))).otherwise(F.lit("no answer"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS vessel, CASE WHEN event_id % 4 < 2 THEN user_id::VARCHAR END AS commodity FROM events")
def llm_json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = answers(spark, sf_dir).select("event_id", chains.parse_answer(F.col("answer"), "vessel string, commodity string").alias("j"))
    return made.select("event_id", "j.vessel", "j.commodity")


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS vessel, CASE WHEN event_id % 4 < 3 THEN user_id::VARCHAR END AS commodity FROM events")
def llm_kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = answers(spark, sf_dir).select("event_id", chains.answer_fields(F.col("answer"), ("vessel", "commodity")).alias("j"))
    return made.select("event_id", "j.vessel", "j.commodity")


@query("WITH f AS (SELECT user_id, max(event_id) AS output FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT DISTINCT user_id FROM events) SELECT user_id, output, CASE WHEN output IS NULL THEN 'active' ELSE 'completed' END AS state FROM a LEFT JOIN f USING (user_id)")
def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs; a purchase completes one."""
    events = table(spark, sf_dir, "events")
    active, done = chains.ledger(events.select("user_id").distinct(), events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("output")), "user_id")
    return active.select("user_id", F.lit(None).cast("long").alias("output"), F.lit("active").alias("state")).union(done.select("user_id", "output", F.lit("completed").alias("state")))


@query("SELECT 'r' || event_id AS custom_id, 0 AS position, event_type AS content FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'r' || event_id, unnest([0, 1]), unnest(['a', event_type]) FROM events WHERE event_id % 2 = 1")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response lines; every second one holds a list."""
    content = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.to_json(F.array(F.lit("a"), "event_type")))
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.concat(F.lit("r"), "event_id").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response"))).alias("value"))
    return chains.results(lines).withColumn("position", F.col("position").cast("int"))


UNTAG = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, {UNTAG("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
 array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {UNTAG('p')}), lambda x: x <> ''), ' ') AS body FROM pages""")
def html_article_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.article(F.col("html")).alias("a")).select("page_id", "a.title", "a.body")


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(pages.links(F.col("html"))).alias("link"))


@query("SELECT page_id, CASE WHEN contains(u, '/wiki/') THEN trim(regexp_replace(replace(u, '_', ' '), '\\s*\\([^)]*\\)$', '')) ELSE u END AS normal FROM (SELECT page_id, url_decode(regexp_replace(split_part(lower(url || '/#x'), '#', 1), '/+$', '')) AS u FROM pages)")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.normalize_url(F.concat("url", F.lit("/#x"))).alias("normal"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 150 AS src, (p_partkey * 7 + p_size) % 150 AS dst FROM part),
w AS (SELECT 3::BIGINT AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 6)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def link_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph made from the parts, walked from node 3 in six steps."""
    edges = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 150).alias("dst")).distinct()
    return pages.walk_links(edges, spark.range(3, 4).toDF("node"), 6)
