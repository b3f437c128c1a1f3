"""Queries on printed chains, code answers, requests, substitutions, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators import chains, evaluate, extract
from textmill.operators.lineage import new_folder
from textmill.plans.registry import query
from textmill.sources import tables
from textmill.sources.tables import table
from textmill.streaming import append


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


BLOCK = "'From: ' || coalesce({f}, 'N/A') || chr(10) || 'To: ' || {t} || chr(10) || 'Subject: ' || {s} || chr(10) || 'Timestamp: N/A' || chr(10) || 'Body: ' || {b}"


@query(f"""SELECT p_partkey, {BLOCK.format(f="CASE WHEN p_partkey % 3 > 0 THEN p_brand END", t="p_type", s="p_name", b="p_name || '!'")}
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {BLOCK.format(f="p_type", t="p_brand", s="'Re: ' || p_name", b="'size ' || p_size")} AS printed FROM part""")
def chain_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of two mails for each part, printed; a sender that is missing is N/A."""
    none = F.lit(None).cast("string")
    first = F.struct(F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("from"), F.col("p_type").alias("to"), F.col("p_name").alias("subject"), none.alias("timestamp"), F.concat("p_name", F.lit("!")).alias("body"))
    second = F.struct(F.col("p_type").alias("from"), F.col("p_brand").alias("to"), F.concat(F.lit("Re: "), "p_name").alias("subject"), none.alias("timestamp"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("body"))
    return parts(spark, sf_dir).select("p_partkey", chains.format_chain(F.array(first, second)).alias("printed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ' and ' || p_brand || '|' END || 'size ' || p_size AS bodies FROM part")
def mail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of printed mails: one over two lines, one that every fourth part leaves empty, one without a head, and a block without a body."""
    first = F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit("\n  and "), "p_brand"))
    text = F.concat(F.lit("From: a\nSubject: Body\nBody: "), first, F.lit("\n-----\nBody:size "), F.col("p_size").cast("string"), F.lit("\n---\nSubject: nothing"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(chains.bodies(text), "|").alias("bodies"))


@query("""SELECT p_partkey, p_name AS entity, 'product' AS type FROM part UNION ALL SELECT p_partkey, p_brand, 'brand' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'none', '' FROM part WHERE p_partkey % 5 = 0""")
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a code answer appends; one without a text is none, one without a type has an empty one."""
    call = lambda t, k: F.concat(F.lit('entities.append({"text": "'), t, F.lit('", "type": "'), k, F.lit('"})\n'))
    code = F.concat(
        F.lit("def run(text):\n    entities = []\n    "), call(F.col("p_name"), F.lit("product")), F.when(F.col("p_partkey") % 3 == 0, call(F.col("p_brand"), F.lit("brand"))).otherwise(""),
        F.when(F.col("p_partkey") % 5 == 0, F.lit('entities.append({"text": "none"})')).otherwise(""), F.lit('entities.append({"type": "empty"})\n    return entities'),
    )
    made = parts(spark, sf_dir).select("p_partkey", F.explode(chains.appended_entities(code)).alias("e"))
    return made.select("p_partkey", F.col("e.text").alias("entity"), F.col("e.type").alias("type"))


@query("""SELECT '{"custom_id":"' || p_partkey || '","params":{"model":"small","max_tokens":256,"messages":[{"role":"user","content":"Describe \\"' || p_name || '\\" of ' || p_brand || '"}]}}' AS value FROM part""")
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit('Describe "'), "p_name", F.lit('" of '), "p_brand")
    return chains.requests(parts(spark, sf_dir).withColumn("prompt", prompt), "p_partkey", "prompt", "small", 256)


FOUND = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN '' ELSE p_brand END"


@query(f"""WITH a AS (SELECT p_type, {FOUND} AS found, p_name AS label FROM part)
SELECT p_type, count(*) AS n, round(avg((found <> '' AND (contains(found, label) OR contains(label, found)))::INT), 6) AS accuracy, round(avg((contains(found, label) OR contains(label, found))::INT), 6) AS lenient FROM a GROUP BY 1""")
def containment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that contain their label or lie in it, without and with empty answers as right ones."""
    made = parts(spark, sf_dir).select("p_type", F.expr(FOUND).alias("found"), F.col("p_name").alias("label"))
    share = lambda empty: F.round(F.avg(evaluate.correct(F.col("found"), F.col("label"), empty).cast("double")), 6)
    return made.groupBy("p_type").agg(F.count("*").alias("n"), share(False).alias("accuracy"), share(True).alias("lenient"))


@query("""SELECT p_partkey, 'Fixed ' || 'MV Star of ' || p_brand || ' with ' || p_name || ' from ' || p_type || ' to port' AS text,
 '1-' || (3 + len(string_split(p_brand, ' '))) || ',' || (7 + len(string_split(p_brand, ' ')) - 1 + len(string_split(p_name, ' '))) || '-' || (7 + len(string_split(p_brand, ' ')) - 1 + len(string_split(p_name, ' '))) AS spans FROM part WHERE NOT regexp_matches(p_brand || p_type || p_name, '[^A-Za-z0-9_ ]')""")
def entity_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of a sentence replaced by entities of other lengths; the later span moves along."""
    rows = parts(spark, sf_dir).where(~F.concat("p_brand", "p_type", "p_name").rlike("[^A-Za-z0-9_ ]"))
    tokens = fx.ner_tokens(F.concat(F.lit("Fixed SHIP with "), "p_name", F.lit(" from PLACE to port")))
    n = F.size(fx.ner_tokens("p_name"))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = F.array(span(F.lit(1), F.lit(1)), span(n + 4, n + 4))
    made = rows.select("p_partkey", extract.substitute(tokens, spans, F.array(F.concat(F.lit("MV Star of "), "p_brand"), F.col("p_type"))).alias("s"))
    shown = F.transform("s.spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return made.select("p_partkey", F.array_join("s.tokens", " ").alias("text"), F.array_join(shown, ",").alias("spans"))


@query("SELECT kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal::DOUBLE), 2) AS total FROM customer, (SELECT unnest(['json', 'jsonl', 'csv', 'parquet']) AS kind) GROUP BY kind")
def files_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in four formats, chosen by suffix, and added up from what is read again."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    schema, frames = "c_custkey long, c_acctbal double, c_mktsegment string", []
    for kind in ("json", "jsonl", "csv", "parquet"):
        path = new_folder(spark, "customers") + f".{kind}"
        tables.write_any(customers, path)
        # a folder of .json holds lines, as Spark writes them
        rows = tables.read_any(spark, path, schema) if kind != "json" else spark.read.schema(schema).json(path)
        frames.append(rows.select(F.lit(kind).alias("kind"), "c_custkey", "c_acctbal"))
    return tables.union_all(frames).groupBy("kind").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT 'r' || event_id AS custom_id, 0 AS position, event_type AS content FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'r' || event_id, unnest([0, 1]), unnest(['a', event_type]) FROM events WHERE event_id % 2 = 1")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come as files of JSON lines, appended by a stream, started twice: nothing is appended twice."""
    content = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.to_json(F.array(F.lit("a"), "event_type")))
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.concat(F.lit("r"), "event_id").alias("custom_id"), content.alias("content"))).alias("value"))
    folder = new_folder(spark, "answers")
    lines.write.text(f"{folder}/in")
    for _ in range(2):
        append.append_results(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("custom_id", F.col("position").cast("int").alias("position"), "content")


@query("SELECT p_partkey, p_name AS text FROM part WHERE p_partkey % 3 = 1")
def blank_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a text that is neither null nor blank, under another name."""
    said = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    made = tables.present(parts(spark, sf_dir).withColumn("said", said), {"p_partkey": "p_partkey", "said": "text", "missing": "gone"})
    return tables.non_blank(made, "text")
