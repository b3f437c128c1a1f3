"""Queries on labels, span formats, training answers, annotations, filters, and mails as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import cleaning
from textmill.operators import labels
from textmill.plans.extract_queries import SPANS_SQL, spans
from textmill.plans.registry import query
from textmill.sources.tables import table


def named_sql(x: str, names: tuple, other: str = "Unknown") -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower({x}), '{w}')" for w in needed) + f" THEN '{name}'" for needed, name in names) + f" ELSE '{other}' END"


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_name END, p_brand) AS vessel, nullif(p_type, '') AS commodity, p_size::VARCHAR AS incoterm, NULL::VARCHAR AS load_port, NULL::VARCHAR AS discharge_port FROM part")
def label_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under other names: an empty vessel gives way to the ship's name."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("").alias("vessel"), F.col("p_brand").alias("ship"), F.col("p_type").alias("commodity"), F.col("p_size").alias("terms"))
    return rows.select("p_partkey", *labels.labels_of(rows))


PATHS = "x AS (SELECT p_partkey, 'out/' || ['AttrPrompting', 'BaseRefine_Llama3B', 'baserefine-llama8b', 'FewShot', 'zeroshot', 'misc'][1 + p_partkey % 6] || '/' || ['Claude', 'deepseek', 'GEMINI', 'gpt-4o', 'gpt4', 'mistral', 'none'][1 + p_partkey % 7] || '.json' AS path FROM part)"


@query(f"WITH {PATHS} SELECT p_partkey, {named_sql('path', labels.METHODS)} AS method, {named_sql('path', labels.MODELS)} AS model FROM x")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), F.col("p_partkey") % len(names))
    path = F.concat(
        F.lit("out/"), pick("AttrPrompting", "BaseRefine_Llama3B", "baserefine-llama8b", "FewShot", "zeroshot", "misc"), F.lit("/"),
        pick("Claude", "deepseek", "GEMINI", "gpt-4o", "gpt4", "mistral", "none"), F.lit(".json"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", labels.named_by(F.col("path"), labels.METHODS).alias("method"), labels.named_by(F.col("path"), labels.MODELS).alias("model"))


SETS = "x AS (SELECT p_partkey, ['attr_prompting', 'bare_llama_3b', 'bare_llama_8b', 'fewshot', 'zeroshot', 'other'][1 + p_partkey % 6] || '_' || ['gpt', 'deepseek', 'claude', 'MISTRAL'][1 + p_partkey % 4] AS name FROM part)"


@query(f"""WITH {SETS}, k AS (SELECT p_partkey, name, {named_sql('name', labels.DATASETS)} AS kind FROM x), l AS (SELECT *, CASE WHEN kind = 'Unknown' THEN name ELSE string_split(name, '_')[-1] END AS last FROM k)
SELECT p_partkey, kind, CASE lower(last) WHEN 'gpt' THEN 'GPT' WHEN 'deepseek' THEN 'DeepSeek' ELSE upper(substr(last, 1, 1)) || lower(substr(last, 2)) END AS model, regexp_extract(name, '^(.*)_([^_]*)$', 1) AS before_last, regexp_extract(name, '^(.*)_([^_]*)$', 2) AS after_last FROM l""")
def dataset_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), F.col("p_partkey") % len(names))
    name = F.concat_ws("_", pick("attr_prompting", "bare_llama_3b", "bare_llama_8b", "fewshot", "zeroshot", "other"), pick("gpt", "deepseek", "claude", "MISTRAL"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    method, model = labels.split_last(F.col("name"))
    return rows.select("p_partkey", *labels.dataset_parts(F.col("name")), method.alias("before_last"), model.alias("after_last"))


@query(SPANS_SQL + ", r AS (SELECT doc_id, start, start + k - 1 AS stop, CASE lower(type) WHEN 'word' THEN 'single' ELSE lower(type) END AS type FROM s) SELECT doc_id, string_agg(start || '-' || stop || ':' || type, ',' ORDER BY start, stop, type) AS spans FROM r GROUP BY 1")
def label_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of a document with their types renamed by a map."""
    one = F.struct("start", "end", F.upper("type").alias("type"))
    rows = spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(one).alias("s")).select("doc_id", F.array_sort(labels.renamed(F.col("s"), {"word": "single"})).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), x["type"])), ",").alias("spans"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '0-' || p_size || ':A,' ELSE '' END || (p_size + 1) || '-' || (p_size + 2) || ':B' AS spans FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, '0-' || p_size || ':A' FROM part WHERE p_partkey % 12 = 0")
def span_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two formats as flat spans; entities without a place go, and so do rows without any span."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    kind = "struct<pos:array<bigint>,start:bigint,end:bigint,type:string>"
    first = F.when(k % 3 == 0, F.struct(F.array(F.lit(0).cast("long"), size).alias("pos"), F.lit(None).alias("start"), F.lit(None).alias("end"), F.lit("A").alias("type")).cast(kind))
    second = F.when(k % 4 != 0, F.struct(F.lit(None).alias("pos"), (size + 1).alias("start"), (size + 2).alias("end"), F.lit("B").alias("type")).cast(kind))
    broken = F.struct(F.lit(None).alias("pos"), size.alias("start"), F.lit(None).alias("end"), F.lit("C").alias("type")).cast(kind)
    made = table(spark, sf_dir, "part").select("p_partkey", labels.flat_spans(F.filter(F.array(first, broken, second), lambda e: e.isNotNull())).alias("s")).where(F.size("s") > 0)
    return made.select("p_partkey", F.array_join(F.transform("s", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), x["type"])), ",").alias("spans"))


@query("""SELECT p_partkey, json_object('vessel', p_name, 'commodity', CASE WHEN p_partkey % 2 = 0 THEN p_type END, 'incoterm', NULL, 'locations', [p_brand, 'X'])::VARCHAR AS answer FROM part""")
def training_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers from "text <> type" annotations; the last vessel counts, and what follows the first sign is the type."""
    tagged = lambda text, kind: F.concat(text, F.lit(f" <> {kind}"))
    goods = F.when(F.col("p_partkey") % 2 == 0, tagged(F.col("p_type"), "commodity")).otherwise("nothing")
    parts = F.array(F.lit("old <> vessel"), tagged(F.col("p_name"), "Vessel "), goods, tagged(F.col("p_brand"), "location"), F.lit("X <> Location"), F.lit("X <> Y <> location"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.answer(parts).alias("answer"))


@query(r"""WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}') AS w FROM documents), a AS (SELECT doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS doc_id, w[1:6] AS e FROM w WHERE len(w) > 0)
SELECT d.doc_id, len(e) AS entities, round(len(list_filter(e, lambda x: contains(t, x))) / len(e)::DOUBLE, 6) AS share FROM w d JOIN a ON a.doc_id = d.doc_id WHERE len(list_filter(e, lambda x: contains(t, x))) / len(e)::DOUBLE >= 0.1""")
def annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with annotations by key, some of which are another document's; those with less than a tenth of their entities in the text go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    words = F.slice(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0)), 1, 6)
    entities = F.transform(words, lambda x: F.concat(x, F.lit(" <> word")))
    key = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    notes = docs.select(key.alias("doc_id"), entities.alias("entities")).where(F.size("entities") > 0)
    made = labels.annotated(docs, notes, ["doc_id"])
    return made.select("doc_id", F.size("entities").cast("long").alias("entities"), F.round(labels.share_found(F.col("text"), F.col("entities")), 6).alias("share"))


SENTENCES = r"s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[.!?]+(\s+[A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 1)) AS s FROM documents)"


@query(
    rf"WITH {SENTENCES} SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE len(regexp_extract_all(s, '\S+')) >= 3 AND regexp_matches(s, '[a-zA-Z]{{3,}}') AND "
    + " AND ".join(f"NOT regexp_matches(s, '(?i){p}')" for p in labels.STRUCTURE + labels.BAD_SIGNS) + ") AS good FROM s GROUP BY 1"
)
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[.!?]+(\s+[A-Z])", "\u0001$1"), "\u0001")
    made = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 1)).alias("s"))
    return made.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(labels.good_sentence(F.col("s"))).alias("good"))


BLOCKED = (("page one", "ref=x"), (r"/[a-z]{2}/[0-9]{1,2}$", r"#top"))


@query("SELECT page_id, url FROM pages WHERE NOT (" + " OR ".join(f"contains(replace(lower(url), '_', ' '), '{c}')" for c in BLOCKED[0]) + f" OR regexp_matches(url, '(?i){'|'.join(BLOCKED[1])}'))")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(~labels.blocked(F.col("url"), *BLOCKED))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END) AS text FROM orders WHERE o_orderkey % 3 < 2 AND NOT contains(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, o_orderstatus), 'LOW')")
def presence_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that is there; rows with none, and rows that tell of an error, go."""
    k = F.col("o_orderkey")
    text = F.coalesce(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 3 == 1, F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).where("text is not null").where(~F.contains("text", F.lit("LOW")))


@query("SELECT p_partkey, 'Offer ' || p_name || ' of ' || p_brand || ' at ' || p_size || ' {open}' AS text, array_to_string(list_filter([p_name || ' <> item', p_brand || ' <> brand'], lambda x: true), '; ') AS harvested FROM part")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled template, and the values that occur in it; a place without a value stays."""
    values = {"item": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}
    text = labels.filled(F.lit("Offer {item} of {brand} at {size} {open}"), values)
    known = F.create_map(F.lit("item"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("port"), F.lit("nowhere"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), known.alias("known"))
    return rows.select("p_partkey", "text", F.array_join(labels.harvested(F.col("text"), F.col("known")), "; ").alias("harvested"))


@query(r"SELECT doc_id, trim(regexp_replace('Re: ' || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Sent: now' || chr(10) || 'To: you' || chr(10) || substr(coalesce(text, ''), 1, 50) ELSE '' END, '(?is)(?:Sent|To|From|Cc):.*', '')) AS kept FROM documents")
def metadata_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nSent: now\nTo: you\n"), F.substring(body, 1, 50))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.without_metadata(F.concat(F.lit("Re: "), body, tail)).alias("kept"))


@query()
def greeting_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of mails without greetings, addresses, dates and signs; compared with plain Python in the tests."""
    whole = F.concat(F.lit("Dear Bob, "), F.coalesce("text", F.lit("")), F.lit(" Best regards, Ann. Thanks"))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.without_greetings(whole).alias("words"))


@query(r"""SELECT c_custkey, 'c' || c_custkey || '@example.com' AS sender, c_mktsegment || ' call' AS subject, 'Balance' || chr(10) || c_acctbal || CASE WHEN c_custkey % 4 = 0 THEN 'second' ELSE '' END AS body FROM customer""")
def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails as files: headers and the plain text, also of several parts without attachments."""
    from textmill.sources.mails import parse_mail

    k = F.col("c_custkey")
    head = F.concat(F.lit("From: c"), k, F.lit("@example.com\nTo: all@example.com\nSubject: "), "c_mktsegment", F.lit(" call\n"))
    text = F.concat(F.lit("Balance\n"), F.col("c_acctbal").cast("string"))
    plain = F.concat(F.lit("\n"), text)
    part = lambda kind, body: F.concat(F.lit(f"\n--xx\n{kind}\n\n"), body)
    many = F.concat(
        F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="xx"\n'), part("Content-Type: text/plain", text), part("Content-Type: text/html", F.lit("<b>no</b>")),
        part('Content-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"', F.lit("attached")), part("Content-Type: text/plain", F.lit("second")), F.lit("\n--xx--\n"),
    )
    raw = F.concat(head, F.when(k % 4 == 0, many).otherwise(plain))
    made = table(spark, sf_dir, "customer").select("c_custkey", parse_mail(raw).alias("m"))
    return made.select("c_custkey", F.col("m.sender").alias("sender"), F.col("m.subject").alias("subject"), F.col("m.body").alias("body"))


THREE = {
    "vessel": "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END",
    "load_port": "CASE p_partkey % 5 WHEN 0 THEN NULL ELSE p_brand END",
    "discharge_port": "CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END",
}


@query(f"WITH l AS (SELECT p_partkey, {', '.join(f'{x} AS {n}' for n, x in THREE.items())} FROM part) SELECT * FROM l WHERE " + " AND ".join(f"trim(coalesce({n}, '')) <> ''" for n in THREE))
def complete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have all three labels."""
    made = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in THREE.items()])
    return labels.complete(made, list(THREE))
