"""Queries on names, places and freight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators import fuzzy, places
from textmill.plans.registry import query
from textmill.sources.tables import table

q = lambda pattern: pattern.replace("'", "''")  # noqa: E731  inside an SQL string
NAMES = r"names AS (SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')[1:1 + doc_id % 3], ' ') AS name FROM documents UNION ALL SELECT -1 - p_partkey, upper(p_name || '-' || p_brand) || CASE p_partkey % 4 WHEN 0 THEN ' IV' WHEN 1 THEN ' (LNG)' WHEN 2 THEN ' 7A' ELSE '' END FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of documents, and upper-case names made from the parts."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), (1 + F.col("doc_id") % 3).cast("int"))
    first = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("name"))
    turn = F.col("p_partkey") % 4
    tail = F.when(turn == 0, " IV").when(turn == 1, " (LNG)").when(turn == 2, " 7A").otherwise("")
    made = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.concat(F.upper(F.concat_ws("-", "p_name", "p_brand")), tail).alias("name"))
    return first.unionByName(made)


BAD_NAMES = " OR ".join([f"regexp_matches(x, '(?i){q(p)}')" for p in fx.TEST_NAMES] + [f"regexp_matches(x, '{q(p)}')" for p in fx.NONSENSE_NAMES] + [f"regexp_matches(x, '{q(fx.SHORT_CODE)}') AND length(x) <= 4"])


@query(rf"""WITH {NAMES}, t AS (SELECT doc_id, trim(name) AS x FROM names)
SELECT doc_id, x AS name, length(x) BETWEEN 4 AND 50 AND len(list_distinct(string_split(replace(x, ' ', ''), ''))) > 2 AND len(regexp_extract_all(x, '\p{{L}}')) >= 2 AND len(regexp_extract_all(x, '{q(fx.SPECIAL_SIGNS)}')) <= 0.3 * length(x) AND NOT ({BAD_NAMES}) AS valid FROM t""")
def name_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", F.trim("name").alias("name"), fx.valid_name("name").alias("valid"))


TITLE = "array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
KEEP = "(" + ", ".join(f"'{a}'" for a in fx.NAME_ABBREVIATIONS) + ")"
FORMATTED = (
    "CASE WHEN contains(w, '(') AND contains(w, ')') THEN array_to_string(list_transform(regexp_extract_all(w, '[()]|[^()]+'), lambda p: CASE WHEN upper(p) IN " + KEEP + " THEN upper(p) ELSE " + TITLE.format(x="p") + " END), '')"
    + f" WHEN upper(w) IN {KEEP} OR regexp_matches(w, '{fx.ROMAN}') OR (regexp_matches(w, '\\p{{N}}') AND length(w) <= 4 AND regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$')) THEN upper(w) ELSE " + TITLE.format(x="w") + " END"
)


@query(rf"WITH {NAMES}, w AS (SELECT doc_id, unnest(regexp_extract_all(name, '\S+')) AS w, unnest(range(len(regexp_extract_all(name, '\S+')))) AS i FROM names), f AS (SELECT doc_id, i, {FORMATTED} AS w FROM w), j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS formatted FROM f GROUP BY 1) SELECT n.doc_id, coalesce(formatted, '') AS formatted FROM names n LEFT JOIN j USING (doc_id)")
def name_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", fx.name_format("name").alias("formatted"))


@query("""WITH w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN replace(c_mktsegment, 'E', 'A') WHEN 1 THEN c_mktsegment || 'S' ELSE 'Customer' END AS name FROM customer), d AS (SELECT DISTINCT c_mktsegment AS known FROM customer),
s AS (SELECT *, 1 - levenshtein(name, known) / greatest(length(name), length(known))::DOUBLE AS s FROM w, d), b AS (SELECT c_custkey, name, s, known FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, known) = 1)
SELECT c_custkey, CASE WHEN s >= 0.8 THEN known ELSE name END AS matched FROM b""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    turn = F.col("c_custkey") % 3
    wrong = F.when(turn == 0, F.replace("c_mktsegment", F.lit("E"), F.lit("A"))).when(turn == 1, F.concat("c_mktsegment", F.lit("S"))).otherwise("Customer")
    made = fuzzy.best_name(customers.withColumn("name", wrong), "name", customers.select("c_mktsegment"), "c_mktsegment")
    return made.select("c_custkey", "matched")


DAMAGED = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'a', 'o') WHEN 1 THEN substr(p_name, 3) WHEN 2 THEN p_name || ' no. ' || p_size ELSE upper(p_name) END"


@query(f"""
WITH w AS (SELECT p_partkey, {DAMAGED} AS name FROM part), d AS (SELECT DISTINCT p_name AS known FROM part), u AS (SELECT DISTINCT name FROM w),
s AS (SELECT name, known, 1 - levenshtein(name, known) / greatest(length(name), length(known))::DOUBLE AS s FROM u, d),
b AS (SELECT name, s, known FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, known) = 1)
SELECT p_partkey, name, CASE WHEN s >= 0.8 THEN known ELSE name END AS matched FROM w JOIN b USING (name)""")
def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with damage of four kinds, against the dictionary of all names of parts."""
    parts = table(spark, sf_dir, "part")
    return fuzzy.best_name(parts.select("p_partkey", F.expr(DAMAGED).alias("name")), "name", parts, "p_name").select("p_partkey", "name", "matched")


POINTS = "p AS (SELECT n_nationkey AS k, n_nationkey * 37 % 160 - 80.0::DOUBLE AS lat, n_nationkey * 101 % 360 - 180.0::DOUBLE AS lon FROM nation)"
KM = "2 * 6371 * asin(sqrt(least(1, power(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians(y.lon - x.lon) / 2), 2))))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with made-up places."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), (k * 37 % 160 - 80.0).alias("lat"), (k * 101 % 360 - 180.0).alias("lon"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.distance_matrix(points(spark, sf_dir), "k", "lat", "lon")


@query(f"WITH {POINTS} SELECT x.k AS origin, y.k AS destination, round({KM}, 4) AS km FROM p x, p y")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).withColumn("km", F.round("km", 4))


ROUTES = f"""WITH {POINTS}, m AS (SELECT x.k AS origin, y.k AS destination, {KM} AS km FROM p x, p y WHERE (x.k + y.k) % 7 <> 0 UNION ALL SELECT x.k, y.k, {KM} + 10 FROM p x, p y WHERE (x.k + y.k) % 7 = 1),
d AS (SELECT origin, destination, avg(km) AS km FROM m GROUP BY 1, 2), r AS (SELECT s_suppkey AS k, s_nationkey AS origin, (s_nationkey * 3 + s_suppkey) % 25 AS destination FROM supplier),
f AS (SELECT k, origin, destination, coalesce(km, 1000) AS km FROM r LEFT JOIN d USING (origin, destination)), q AS (SELECT *, 30 + km / 1000 * 4.5 AS rate FROM f)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of suppliers with their distance; some pairs of places are missing and some stand twice."""
    every = matrix(spark, sf_dir)
    turn = (F.col("origin") + F.col("destination")) % 7
    known = every.where(turn != 0).unionByName(every.where(turn == 1).withColumn("km", F.col("km") + 10))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("origin"), ((F.col("s_nationkey") * 3 + F.col("s_suppkey")) % 25).alias("destination"))
    return places.with_distance(own, known, "origin", "destination", F.lit(1000.0))


@query(ROUTES + " SELECT k, origin, destination, round(km, 4) AS km, round(rate, 6) AS rate FROM q")
def freight_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = routes(spark, sf_dir)
    return made.select("k", "origin", "destination", F.round("km", 4).alias("km"), F.round(places.rate(F.col("km"), 4.5), 6).alias("rate"))


@query(ROUTES + ", i AS (SELECT k, round_even(rate, 0)::BIGINT AS r FROM q) SELECT k, (CASE WHEN r - r // 10 * 10 <= 3 THEN 'low' WHEN r - r // 10 * 10 <= 6 THEN 'mid' ELSE 'high' END) || ' ' || (r // 10 * 10) || 's' AS bucket FROM i")
def rate_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select("k", places.rate_bucket(places.rate(F.col("km"), 4.5)).alias("bucket"))


@query(ROUTES + ", i AS (SELECT k, origin, round_even(rate, 0)::BIGINT AS r FROM q), b AS (SELECT origin, arg_min(r, k) AS base, min(k) AS first FROM i GROUP BY 1) SELECT k, origin, CASE WHEN k = first THEN r ELSE r - base END AS quote FROM i JOIN b USING (origin)")
def parity_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = routes(spark, sf_dir).withColumn("rate", places.rate(F.col("km"), 4.5))
    first = made.groupBy("origin").agg(F.min("k").alias("first"))
    marked = made.join(first, "origin")
    return places.parity_deltas(marked, "origin", F.col("k") == F.col("first"), "rate").select("k", "origin", "quote")


#: Regions by code, a parameter of the operator; here some keys of the test tables.
REGIONS = {"EU": ("0", "1", "2", "3"), "AS": ("4", "5", "6"), "NA": ("7", "8"), "SA": ("9", "10", "11"), "AF": ("12", "13"), "OC": ("14", "15")}


@query("SELECT n_nationkey, CASE " + " ".join(f"WHEN n_nationkey::VARCHAR IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in REGIONS.items()) + " ELSE 'OT' END AS region FROM nation")
def region_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", places.region(F.col("n_nationkey").cast("string"), REGIONS).alias("region"))


PLACED = "c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE lpad((p_partkey * 7 % 90)::VARCHAR, 2, '0') || lpad((p_partkey % 60)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'S' END || ' ' || lpad((p_partkey * 11 % 180)::VARCHAR, 3, '0') || lpad((p_partkey * 13 % 60)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN 'E' ELSE 'W' END END AS x FROM part)"


@query(f"WITH {PLACED} SELECT p_partkey, CASE WHEN ok THEN round((substr(x, 1, 2)::INT + substr(x, 3, 2)::INT / 60.0::DOUBLE) * CASE substr(x, 5, 1) WHEN 'S' THEN -1 ELSE 1 END, 6) END AS latitude, CASE WHEN ok THEN round((substr(x, 7, 3)::INT + substr(x, 10, 2)::INT / 60.0::DOUBLE) * CASE substr(x, 12, 1) WHEN 'W' THEN -1 ELSE 1 END, 6) END AS longitude FROM (SELECT *, regexp_matches(x, '^[0-9]{{4}}[NS] [0-9]{{5}}[EW]$') AS ok FROM c)")
def parse_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = F.concat(pad(k * 7 % 90, 2), pad(k % 60, 2), F.when(k % 2 == 0, "N").otherwise("S"), F.lit(" "), pad(k * 11 % 180, 3), pad(k * 13 % 60, 2), F.when(k % 3 == 0, "E").otherwise("W"))
    at = fx.parse_coordinates(F.when(k % 5 == 0, F.col("p_name")).otherwise(made))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(at["latitude"], 6).alias("latitude"), F.round(at["longitude"], 6).alias("longitude"))


@query("WITH f AS (SELECT p_partkey, lpad((p_partkey * 31 % 100000)::VARCHAR, 8, '-') AS f FROM part) SELECT p_partkey, contains(f, '1') AS is_port, contains(f, '4') AS is_airport, contains(f, '6') AS is_terminal FROM f WHERE contains(f, '1')")
def ports_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.lpad((F.col("p_partkey") * 31 % 100000).cast("string"), 8, "-")
    return table(spark, sf_dir, "part").select("p_partkey", *places.port_facts(f)).where("is_port")


@query(f"""WITH c AS (SELECT p_partkey, upper(p_name) || ' ANCH' AS name, p_type AS country, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '[''-'', ''' || p_brand || ''']' ELSE '[''' || p_name || ''', '''', ''x y'']' END AS others FROM part),
b AS (SELECT p_partkey, name, country, list_filter(list_transform(string_split(regexp_replace(coalesce(others, ''), '[\\[\\]''"]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '' AND x <> '-') AS b FROM c)
SELECT p_partkey, array_to_string(list_concat([trim(replace({TITLE.format(x="name")}, 'Anch', '')) || ', ' || {TITLE.format(x="country")}], list_transform(b, lambda x: x || ', ' || {TITLE.format(x="country")})), ' | ') AS lookups FROM b""")
def place_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("p_partkey") % 3
    others = F.when(turn == 1, F.concat(F.lit("['-', '"), "p_brand", F.lit("']"))).when(turn == 2, F.concat(F.lit("['"), "p_name", F.lit("', '', 'x y']")))
    made = places.place_queries(F.concat(F.upper("p_name"), F.lit(" ANCH")), F.col("p_type"), others)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(made, " | ").alias("lookups"))


CODE = "chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + floor(c_custkey / 26) % 26 AS INT))"


@query(f"WITH c AS (SELECT c_custkey, {CODE} AS code FROM customer) SELECT c_custkey, code, CASE " + " ".join(f"WHEN code IN ({', '.join(map(repr, codes))}) THEN '{name}'" for name, codes in places.REGIONS.items()) + " ELSE 'OT' END AS region FROM c")
def country_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a two-letter code made from their key, and the region of that country."""
    made = table(spark, sf_dir, "customer").select("c_custkey", F.expr(CODE).alias("code"))
    return made.withColumn("region", places.region(F.col("code")))
