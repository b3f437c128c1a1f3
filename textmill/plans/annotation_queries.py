"""Queries on values, entities, prompts, masks, and small joins and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.operators import annotate, extract, sampling
from textmill.operators.rollup import overall_rank
from textmill.plans.extract_queries import MAILS_SQL, SPANS_SQL, mails, rule_sql, spans
from textmill.plans.registry import query
from textmill.sources.tables import table

VALUES = "v AS (SELECT p_partkey, ['mv ', 'M/V ', ''][1 + p_partkey % 3] || p_name || ' LAYCAN EUR25 ' || p_type || ' TERMS Soybeans' AS v FROM part)"


@query(rf"WITH {VALUES} SELECT p_partkey, trim(regexp_replace(lower(trim(v)), 'mv\s+|m/v\s+', '', 'g')) AS vessel, trim(regexp_replace(lower(trim(v)), 'laycan|eur\d+', '', 'g')) AS port, trim(replace(lower(trim(v)), 'terms', '')) AS incoterm, replace(lower(trim(v)), 'soybeans', 'soybean') AS commodity FROM v")
def normal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(F.lit("mv "), F.lit("M/V "), F.lit("")), F.col("p_partkey") % 3)
    v = F.concat(lead, "p_name", F.lit(" LAYCAN EUR25 "), "p_type", F.lit(" TERMS Soybeans"))
    return table(spark, sf_dir, "part").select("p_partkey", *[annotate.normal_value(v, k).alias(k) for k in ("vessel", "port", "incoterm", "commodity")])


@query("""WITH e AS (SELECT p_partkey, string_split(CASE p_partkey % 4 WHEN 0 THEN 'MV ' || p_name WHEN 1 THEN p_name || ' , ' || p_brand WHEN 2 THEN p_type ELSE 'a/b ' || p_size END, ' ') AS t, ['vessel name', 'location', 'incoterm'][1 + p_partkey % 3] AS l FROM part)
SELECT p_partkey, round(least(1, CASE WHEN len(t) > 1 THEN 0.2 + 0.1 * least(len(t) - 1, 3) ELSE 0 END + CASE WHEN len(list_filter(t, lambda x: x IN ('M/V', 'MV', 'MT', 'MS', 'm/v'))) > 0 THEN 0.15 ELSE 0 END
 + CASE WHEN len(list_filter(t, lambda x: x IN (',', '-', '/', '(', ')'))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 0.15 ELSE 0 END
 + CASE WHEN len(list_filter(t, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) > 0 THEN 0.1 ELSE 0 END + CASE WHEN l = 'location' AND len(t) > 2 THEN 0.2 WHEN l = 'vessel name' AND contains(array_to_string(t, ' '), '/') THEN 0.1 WHEN l = 'incoterm' THEN 0.1 ELSE 0 END), 6) AS complexity FROM e""")
def entity_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("MV "), "p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(" , "), "p_brand")).when(k % 4 == 2, F.col("p_type")).otherwise(F.concat(F.lit("a/b "), "p_size"))
    label = F.get(F.array(F.lit("vessel name"), F.lit("location"), F.lit("incoterm")), k % 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(annotate.complexity(F.split(text, " "), label), 6).alias("complexity"))


@query("WITH m AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 <> 0 THEN '<a> ' ELSE '' END || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' <b> x' WHEN 1 THEN ' <c> y' ELSE '' END AS t FROM part), r AS (SELECT p_partkey, contains(t, '<a>') AS has, substr(t, instr(t, '<a>') + 3) AS rest FROM m) SELECT p_partkey, CASE WHEN has THEN trim(CASE WHEN contains(rest, '<b>') THEN substr(rest, 1, instr(rest, '<b>') - 1) WHEN contains(rest, '<c>') THEN substr(rest, 1, instr(rest, '<c>') - 1) ELSE rest END) END AS found FROM r")
def between_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat("p_name", F.when(k % 5 != 0, "<a> ").otherwise(""), "p_brand", F.when(k % 3 == 0, " <b> x").when(k % 3 == 1, " <c> y").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", annotate.between(F.col("t"), "<a>", "<b>", "<c>").alias("found"))


@query("WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_partkey ELSE (p_partkey * 7919 % 1000)::VARCHAR END AS id FROM part) SELECT p_partkey, row_number() OVER (ORDER BY try_cast(id AS BIGINT) NULLS LAST, id, p_partkey) AS place FROM i")
def id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of ids in order of their number; those that are none follow by text."""
    k = F.col("p_partkey")
    ids = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.concat("p_name", k)).otherwise((k * 7919 % 1000).cast("string")).alias("id"))
    number = F.expr("try_cast(id AS bigint)")
    return overall_rank(ids, [number.asc_nulls_last(), F.col("id"), k], "place").select("p_partkey", "place")


@query("WITH r AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, event_id FROM r WHERE r <= least(floor(10 + 20 * (user_id % 10) / 10.0), 20)")
def relevance_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of a user's dearest events as its relevance allows: 10 to 20 (a top-k report)."""
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    cap = F.least(F.floor(10 + 20 * (F.col("user_id") % 10) / 10.0), F.lit(20))
    return table(spark, sf_dir, "events").withColumn("r", r).where(F.col("r") <= cap).select("user_id", "event_id")


@query("WITH c AS (SELECT user_id, event_id AS step, 'run-' || user_id || '/step-' || event_id AS path FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS r FROM c) SELECT user_id, max(path) FILTER (WHERE r = 1) AS latest, count(*) FILTER (WHERE r > 3) AS removable FROM r GROUP BY 1")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step's path of each run, and how many are beyond the last three."""
    path = F.concat(F.lit("run-"), "user_id", F.lit("/step-"), "event_id")
    made = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(path, "event_id").alias("latest"), F.count("*").alias("n"))
    return made.select("user_id", "latest", F.greatest(F.col("n") - 3, F.lit(0)).alias("removable"))


@query("SELECT lower(trim(p_type)) AS term FROM part UNION SELECT lower(trim(c_mktsegment)) FROM customer UNION SELECT lower(event_type) FROM events")
def term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (table(spark, sf_dir, t).select(F.lower(F.trim(c)).alias("term")) for t, c in (("part", "p_type"), ("customer", "c_mktsegment"), ("events", "event_type")))
    first, second, third = parts
    return first.union(second).union(third).distinct()


@query(SPANS_SQL + ' SELECT doc_id, entity, min(start) AS start, min(start + k - 1) AS "end" FROM s GROUP BY 1, 2')
def first_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of each entity in a document."""
    return spans(spark, sf_dir).groupBy("doc_id", "entity").agg(F.min("start").alias("start"), F.min("end").alias("end"))


CODE_SQL = rule_sql(MAILS_SQL, "p_partkey", rf"(?:^|[^A-Za-z])({'|'.join(extract.CODES)})(?:$|[^A-Za-z])", 1)
FOUR = {"vessels": rule_sql(MAILS_SQL, "p_partkey", extract.PREFIXED, 1), "ports": rule_sql(MAILS_SQL, "p_partkey", extract.FROM_TO, 2), "commodities": rule_sql(MAILS_SQL, "p_partkey", extract.QUANTITY, 2), "incoterms": CODE_SQL}


@query("SELECT p_partkey, " + ", ".join(f"{n}.found AS {n}" for n in FOUR) + " FROM " + " JOIN ".join(f"({sql}) {n}" + (" USING (p_partkey)" if i else "") for i, (n, sql) in enumerate(FOUR.items())))
def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of entities of a mail at once."""
    joined = lambda c: F.array_join(c, ",")
    m = F.col("m")
    return mails(spark, sf_dir).select(
        "p_partkey", joined(extract.extract_distinct(m, extract.PREFIXED, 1)).alias("vessels"), joined(extract.extract_distinct(m, extract.FROM_TO, 2)).alias("ports"),
        joined(extract.extract_distinct(m, extract.QUANTITY, 2)).alias("commodities"), joined(extract.code_matches(m)).alias("incoterms"),
    )


TONES, PORTS = ("formal", "short", "friendly"), ("Oslo", "Lagos", "Busan", "Santos", "Genoa")


def u_sql(key: str, seed: int) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {key}, {seed})), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"


def choice_sql(key: str, names: tuple[str, ...], seed: int) -> str:
    return f"{list(names)}[1 + least(floor({u_sql(key, seed)} * {len(names)}), {len(names) - 1})::BIGINT]"


@query(f"""WITH a AS (SELECT p_partkey, p_name, p_size, {choice_sql('p_partkey', TONES, 1)} AS tone, list_transform(list_sort(list_transform({list(PORTS)}, lambda x: md5(concat_ws(':', p_partkey || '/' || x, 2)) || x)), lambda x: substr(x, 33))[1:3] AS ports FROM part)
SELECT p_partkey, 'Write a ' || tone || ' mail on ' || p_size || ' ' || p_name || ' from ' || ports[1] || ' to ' || ports[2] || '. Other port: ' || ports[3] AS prompt FROM a""")
def prompt_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt with a tone and three different ports, drawn by hash."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", annotate.choice(key, TONES, 1).alias("tone"), annotate.few(key, PORTS, 3, 2).alias("ports"))
    port = lambda i: F.get("ports", F.lit(i))
    prompt = F.concat(F.lit("Write a "), "tone", F.lit(" mail on "), "p_size", F.lit(" "), "p_name", F.lit(" from "), port(0), F.lit(" to "), port(1), F.lit(". Other port: "), port(2))
    return rows.select("p_partkey", prompt.alias("prompt"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), u AS (SELECT doc_id, w, unnest(w) AS t, unnest(range(len(w))) AS i FROM t),
m AS (SELECT doc_id, i, t, w[1 + (i * 7 + 3) % len(w)] AS other, """ + u_sql("doc_id || '/' || i", 42) + r""" / 0.15 AS u FROM u)
SELECT doc_id, md5(string_agg(CASE WHEN u <= 0.8 THEN '[MASK]' WHEN u <= 0.9 THEN other ELSE t END, ' ' ORDER BY i)) AS masked, count(*) FILTER (WHERE u <= 0.8) AS masks FROM m GROUP BY 1""")
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the filter asks the text, as one on the masked tokens would make them once more
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    facts = lambda m: F.struct(F.md5(F.array_join(m, " ").cast("binary")).alias("masked"), F.size(F.filter(m, lambda x: x == "[MASK]")).cast("long").alias("masks"))
    return docs.select("doc_id", F.inline(F.transform(F.array(annotate.masked(tokens, F.col("doc_id"))), facts)))


@query("SELECT event_id, ['news', 'mail', 'wiki'][1 + event_id % 3] AS data_set, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id IN (SELECT s_suppkey FROM supplier)")
def allowed_and_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of allowed types whose user is known, dealt to three data sets in turn."""
    turn = F.get(F.array(F.lit("news"), F.lit("mail"), F.lit("wiki")), F.col("event_id") % 3)
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).join(known, "user_id", "left_semi")
    return rows.select("event_id", turn.alias("data_set"), "event_type")


@query("WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'click'), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'view') SELECT user_id, i, a.value AS human, b.value AS machine FROM a FULL JOIN b USING (user_id, i) WHERE a.value IS NOT NULL AND b.value IS NOT NULL")
def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of scores side by side by place, without the rest of the longer one."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    side = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", place.alias("i"), F.col("value").alias(name))
    return side("click", "human").join(side("view", "machine"), ["user_id", "i"])


@query("WITH c AS (SELECT conv_id, count(*) AS mails, sum(length(trim(coalesce(text, '')))) AS size, avg(length(text) % 100) / 100 AS p FROM conversations GROUP BY 1) SELECT conv_id, mails, CASE WHEN size = 0 THEN 0 ELSE round(p, 6) END AS first, CASE WHEN size = 0 THEN 1 ELSE 0 END AS neutral FROM c")
def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of scores a chain with its number of mails; a chain without text is neutral."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("mails"), F.sum(size).alias("size"), (F.avg(F.length("text") % 100) / 100).alias("p"))
    return made.select("conv_id", "mails", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.round("p", 6)).alias("first"), F.when(F.col("size") == 0, 1).otherwise(0).alias("neutral"))


ORDER = ("purchase", "view", "click", "error")


@query("WITH m AS (SELECT event_type AS name, round(avg(value), 6) AS mean FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, round(avg(o_totalprice), 6) FROM orders GROUP BY 1), p AS (SELECT name, mean, list_position(['purchase', 'view', 'click', 'error'], name) AS place FROM m) SELECT name, mean, place::INT AS place FROM p WHERE place IS NOT NULL")
def ordered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two tables, those of the listed names in the order of the list."""
    mean = lambda t, by, v: table(spark, sf_dir, t).groupBy(F.col(by).alias("name")).agg(F.round(F.avg(v), 6).alias("mean"))
    both = mean("events", "event_type", "value").unionByName(mean("orders", "o_orderstatus", "o_totalprice")).where(F.col("name").isin(*ORDER))
    return both.withColumn("place", F.array_position(F.array(*[F.lit(n) for n in ORDER]), F.col("name")).cast("int"))


@query("SELECT p_partkey, lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ',' || lower(p_brand) ELSE '' END AS types, p_size::BIGINT AS last_end FROM part")
def printed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that were printed as a list of dictionaries, read back."""
    one = lambda kind, end: F.concat(F.lit("{'type': '"), kind, F.lit("', 'pos': [0, "), end, F.lit("], 'note': None}"))
    text = F.concat(F.lit("["), F.when(F.col("p_partkey") % 2 == 0, F.concat(one(F.col("p_type"), F.lit("1")), F.lit(", "), one(F.col("p_brand"), F.col("p_size")))).otherwise(one(F.col("p_type"), F.col("p_size"))), F.lit("]"))
    rows = table(spark, sf_dir, "part").select("p_partkey", annotate.listed_entities(text, "array<struct<type:string,pos:array<bigint>,note:string>>").alias("e"))
    return rows.select("p_partkey", F.array_join(F.transform("e", lambda x: F.lower(x["type"])), ",").alias("types"), F.get(F.element_at("e", -1)["pos"], F.lit(1)).alias("last_end"))


@query("SELECT p_partkey * 10 + i AS id, p_type AS category, CASE WHEN i = 0 THEN p_brand END AS author, 'https://example.com/news/' || lower(p_type) || '/' || p_partkey || '-' || i AS url FROM part, (VALUES (0), (1)) v(i) WHERE p_partkey % 2 = 0 OR i = 0")
def nested_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from pages of nested JSON answers: lists of lists are flattened, fields projected, addresses built."""
    k = F.col("p_partkey")
    item = lambda i, author: F.struct(
        (k * 10 + i).alias("id"), F.struct(F.struct(F.col("p_type").alias("id")).alias("data")).alias("category"),
        F.struct(F.struct(F.struct(author.alias("name")).alias("attributes")).alias("data")).alias("author"), F.concat_ws("-", k, F.lit(i)).alias("slug"),
    )
    pages = F.array(F.array(item(0, F.col("p_brand"))), F.when(k % 2 == 0, F.array(item(1, F.lit(None).cast("string")))).otherwise(F.array()))
    answer = F.to_json(F.struct(pages.alias("pages")))
    schema = "pages array<array<struct<id:bigint,category:struct<data:struct<id:string>>,author:struct<data:struct<attributes:struct<name:string>>>,slug:string>>>"
    made = table(spark, sf_dir, "part").select(F.explode(F.flatten(F.from_json(answer, schema)["pages"])).alias("a"))
    category = F.col("a.category.data.id")
    return made.select("a.id", category.alias("category"), F.col("a.author.data.attributes.name").alias("author"), F.concat_ws("/", F.lit("https://example.com/news"), F.lower(category), "a.slug").alias("url"))


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', doc_id, 42)), doc_id) AS r FROM documents) SELECT source, doc_id, CASE WHEN r <= 2 THEN 'sample' ELSE 'buffer' END AS part FROM r WHERE r <= 5")
def sample_and_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of each source and three to fall back on (a sampling operator)."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    r = F.row_number().over(W.partitionBy("source").orderBy(sampling.draw("doc_id"), "doc_id"))
    return docs.withColumn("r", r).where("r <= 5").select("source", "doc_id", F.when(F.col("r") <= 2, "sample").otherwise("buffer").alias("part"))


@query("SELECT s_suppkey, n_name, n_regionkey, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of small tables at each row; Spark broadcasts them while they are small."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    made = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return made.select("s_suppkey", "n_name", "n_regionkey", "r_name")


@query()
def logistic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length and share of signs tell good from bad documents; fitted and measured on all labelled rows."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    signs = F.regexp_count("text", F.lit("[#$%&*]")) / F.greatest(F.length("text"), F.lit(1))
    return annotate.logistic_split(docs.select(F.ln(1 + F.col("n_chars")).alias("size"), signs.alias("signs"), "quality"), ["size", "signs"], "quality")
